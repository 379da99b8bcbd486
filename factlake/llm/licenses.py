"""License scans (operator 11).

One Aho-Corasick automaton walks each text once and finds base phrases, notice phrases and identifier
tags at word boundaries. What follows a tag is a licence expression, and so are notices that only
``and``, ``or``, ``with`` and small words part; a shunting-yard parser evaluates both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import carried, held_by_worker, restored

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words of the tag that an expression follows.
TAG = "spdx license identifier"
#: Public licence identifiers, and how freely each lets a text be used (1: at will, 0: not at all).
FREEDOM = {
    "0BSD": 1.0, "CC0-1.0": 1.0, "Unlicense": 1.0, "WTFPL": 1.0, "PDDL-1.0": 1.0,
    "Apache-1.1": 0.9, "Apache-2.0": 0.9, "Artistic-2.0": 0.9, "BSD-2-Clause": 0.9, "BSD-3-Clause": 0.9, "BSL-1.0": 0.9, "CC-BY-3.0": 0.9, "CC-BY-4.0": 0.9,
    "ISC": 0.9, "MIT": 0.9, "MIT-0": 0.9, "NCSA": 0.9, "ODC-By-1.0": 0.9, "OpenSSL": 0.9, "PostgreSQL": 0.9, "PSF-2.0": 0.9, "Python-2.0": 0.9, "Zlib": 0.9,
    "CC-BY-SA-3.0": 0.6, "CC-BY-SA-4.0": 0.6, "CDDL-1.0": 0.6, "EPL-1.0": 0.6, "EPL-2.0": 0.6, "LGPL-2.0": 0.6, "LGPL-2.0-only": 0.6, "LGPL-2.0-or-later": 0.6,
    "LGPL-2.1": 0.6, "LGPL-2.1-only": 0.6, "LGPL-2.1-or-later": 0.6, "LGPL-3.0": 0.6, "LGPL-3.0-only": 0.6, "LGPL-3.0-or-later": 0.6, "MPL-1.1": 0.6, "MPL-2.0": 0.6, "ODbL-1.0": 0.6,
    "EUPL-1.2": 0.3, "GFDL-1.3": 0.3, "GFDL-1.3-only": 0.3, "GFDL-1.3-or-later": 0.3, "GPL-1.0": 0.3, "GPL-2.0": 0.3, "GPL-2.0-only": 0.3, "GPL-2.0-or-later": 0.3,
    "GPL-3.0": 0.3, "GPL-3.0-only": 0.3, "GPL-3.0-or-later": 0.3, "AGPL-3.0": 0.2, "AGPL-3.0-only": 0.2, "AGPL-3.0-or-later": 0.2, "SSPL-1.0": 0.2,
    "CC-BY-NC-4.0": 0.1, "CC-BY-NC-SA-4.0": 0.1, "CC-BY-NC-ND-4.0": 0.1, "CC-BY-ND-4.0": 0.1, "BUSL-1.1": 0.1,
}
#: Exceptions that ``with`` may add; each lets a work be linked, so what stands before it counts as 0.6 at least.
EXCEPTIONS = (
    "Autoconf-exception-3.0", "Bison-exception-2.2", "Classpath-exception-2.0", "Font-exception-2.0", "GCC-exception-3.1", "Linux-syscall-note", "LLVM-exception",
    "OpenJDK-assembly-exception-1.0", "Universal-FOSS-exception-1.0",
)
LINKED = 0.6
#: Notice phrases, their labels, and how freely they let a text be used.
NOTICES = {
    "apache license": ("apache", 0.9), "mit license": ("mit", 0.9), "permission is hereby granted free of charge": ("mit", 0.9), "isc license": ("isc", 0.9),
    "bsd license": ("bsd", 0.9), "redistribution and use in source and binary forms": ("bsd", 0.9), "boost software license": ("bsl", 0.9), "zlib license": ("zlib", 0.9),
    "mozilla public license": ("mpl", 0.6), "eclipse public license": ("epl", 0.6), "lesser general public license": ("lgpl", 0.6), "affero general public license": ("agpl", 0.2),
    "gnu general public license": ("gpl", 0.3), "free documentation license": ("gfdl", 0.3), "european union public licence": ("eupl", 0.3),
    "cc0": ("cc0", 1.0), "public domain dedication": ("cc0", 1.0), "cc by sa": ("cc-by-sa", 0.6), "cc by nd": ("cc-by-nd", 0.1), "cc by nc": ("cc-by-nc", 0.1),
    "cc by nc sa": ("cc-by-nc-sa", 0.1), "cc by nc nd": ("cc-by-nc-nd", 0.1), "creative commons attribution": ("cc-by", 0.9),
    "creative commons attribution sharealike": ("cc-by-sa", 0.6), "creative commons attribution share alike": ("cc-by-sa", 0.6),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.1), "creative commons attribution non commercial": ("cc-by-nc", 0.1),
    "classpath exception": ("classpath-exception", None), "linking exception": ("linking-exception", None),
}
#: What base phrases let a text be used for.
BASE_FREEDOM = {"cc-by": 0.9, "gpl": 0.3, "reserved": 0.0}
#: How surely a licence is stated by a whole expression behind a tag, one that can't be read, and phrases of 3 words and more and of fewer.
SURE = {"tag": 0.95, "broken": 0.5, "long": 0.8, "short": 0.6}
#: Words that may stand between a notice and what joins it to the next.
_SMALL = {b"the", b"a", b"an", b"either", b"both", b"version", b"v", b"licence", b"license", b"at", b"your", b"option", b"gnu"}
_JOINS = {b"and", b"or", b"with"}
#: Words between two notices that are joined, at most.
GAP = 8

#: Bytes as words see them: A-Z lower-cased, all but letters, digits and bytes above ASCII a blank.
_AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_EXPRESSION = re.compile(rb"[ \t]*[:=]?[ \t]*([^\r\n]*)")
_PART = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_KNOWN = {k.lower(): v for k, v in FREEDOM.items()}
_EXCEPTED = {e.lower() for e in EXCEPTIONS}


@dataclass(frozen=True)
class Value:
    """What an expression comes to: its normal form, how tightly that binds, its labels, its freedom (None: an exception)."""

    form: str
    binds: int
    labels: tuple[str, ...]
    freedom: float | None


_BINDS = {"or": 1, "and": 2, "with": 3}


def _applied(op: str, a: Value, b: Value) -> Value:
    labels = (*a.labels, *b.labels)
    sides = [f"({x.form})" if x.binds < _BINDS[op] else x.form for x in (a, b)]
    form = f"{sides[0]} {op.upper()} {sides[1]}"
    if op == "with":
        if b.freedom is not None or a.freedom is None or a.binds < 3:
            raise ValueError("with takes a licence and an exception")
        return Value(form, 3, labels, max(a.freedom, LINKED) if a.freedom else a.freedom)
    if a.freedom is None or b.freedom is None:
        raise ValueError("an exception needs a licence")
    return Value(form, _BINDS[op], labels, max(a.freedom, b.freedom) if op == "or" else min(a.freedom, b.freedom))


def evaluated(parts: Sequence[str | Value]) -> Value | None:
    """The value of an expression in infix order: values, ``and``, ``or``, ``with`` and parentheses.

    Two stacks, of values and of operators; ``with`` binds more tightly than ``and``, and that than ``or``; equals go
    from left to right. None where the parts are no expression.
    """
    values: list[Value] = []
    ops: list[str] = []
    value_next = True
    try:
        for part in parts:
            if isinstance(part, Value):
                if not value_next:
                    return None
                values.append(part)
                value_next = False
            elif part == "(":
                if not value_next:
                    return None
                ops.append(part)
            elif value_next:
                return None
            elif part == ")":
                while ops[-1] != "(":
                    _apply(values, ops)
                ops.pop()
            else:
                while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[part]:
                    _apply(values, ops)
                ops.append(part)
                value_next = True
        while ops:
            if ops[-1] == "(":
                return None
            _apply(values, ops)
    except (IndexError, ValueError):
        return None
    return values[0] if len(values) == 1 and not value_next and values[0].freedom is not None else None


def _apply(values: list[Value], ops: list[str]) -> None:
    b, a = values.pop(), values.pop()
    values.append(_applied(ops.pop(), a, b))


def licence(name: str) -> Value | None:
    """The value of an identifier or exception; None where it is neither. References of one's own are unfree."""
    low = name.lower()
    if low in _EXCEPTED:
        return Value(low, 3, (), None)
    if low.startswith(("licenseref-", "documentref-")):
        return Value(low, 3, (low,), 0.0)
    if low.endswith("+") and low[:-1] in _KNOWN:
        later = f"{low[:-1]}-or-later"
        low = later if later in _KNOWN else low
        return Value(low, 3, (low,), _KNOWN.get(low, _KNOWN.get(low.rstrip("+"))))
    return Value(low, 3, (low,), _KNOWN[low]) if low in _KNOWN else None


def read_expression(line: str) -> tuple[str, Value | None]:
    """What stands behind a tag up to the end of its expression, and its value.

    The expression ends where two values or two operators would meet, at a parenthesis that closes nothing, or
    at what is neither a name nor a parenthesis.
    """
    parts: list[str | Value] = []
    end, depth, value_next = 0, 0, True
    for m in _PART.finditer(line):
        if line[end : m.start()].strip(" \t"):
            break
        part = m.group()
        joins = part.lower() in _BINDS
        if part == "(" or not joins and part != ")":
            if not value_next:
                break
            if part == "(":
                depth += 1
                parts.append(part)
            else:
                value_next = False
                parts.append(licence(part.rstrip(".:")) or Value("", 3, (), None))
        elif part == ")":
            if not depth:
                break
            depth -= 1
            parts.append(part)
        else:
            if value_next:
                break
            value_next = True
            parts.append(part.lower())
        end = m.end()
    if any(isinstance(p, Value) and not p.form for p in parts):
        return line[:end].strip(), None
    return line[:end].strip(), evaluated(parts)


class Scanner:
    """The automaton of all phrases, and what is made of its finds."""

    def __init__(self, base: Mapping[str, str], notices: Mapping[str, tuple[str, float | None]]):
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[str, str, int, float | None]]] = {}
        for phrase, label in base.items():
            found.setdefault(phrase, []).append(("base", label, len(phrase.split()), BASE_FREEDOM.get(label, 0.0)))
        for phrase, (label, freedom) in notices.items():
            found.setdefault(phrase, []).append(("exception" if freedom is None else "notice", label, len(phrase.split()), freedom))
        found.setdefault(TAG, []).append(("tag", "", len(TAG.split()), None))
        for phrase, whats in found.items():
            self.automaton.add_word(f" {_latin(phrase)} ", (len(_latin(phrase)) + 1, whats))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[dict], list[dict]]:
        """The number of words, all finds in the order of their words, and all statements."""
        raw = text.encode("utf-8", "surrogatepass")
        words = (seen := raw.translate(_AS_WORDS)).split()
        joined = b" ".join([b"", *words, b""]) if words else b""
        hits = [(end - back, what) for end, (back, whats) in self.automaton.iter(joined.decode("latin-1")) for what in whats]
        if not hits:
            return len(words), [], []
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)  # a hit begins at the blank before its first word
        at = np.searchsorted(blanks, [h[0] for h in hits]).tolist()
        finds = sorted(((w, what) for w, (_, what) in zip(at, hits)), key=lambda f: (f[0], f[1][0], -f[1][2], f[1][1]))
        listed = [{"kind": kind, "label": label, "word": w, "n_words": n} for w, (kind, label, n, _) in finds if kind != "tag"]
        return len(words), listed, [*self._tagged(raw, seen, finds), *self._joined(words, finds)]

    @staticmethod
    def _tagged(raw: bytes, seen: bytes, finds: list) -> Iterator[dict]:
        tags = [w + n - 1 for w, (kind, _, n, _) in finds if kind == "tag"]
        if not tags:
            return
        inside = np.concatenate([np.frombuffer(seen, np.uint8) != 32, [False]])
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1  # of words, in bytes
        for last in tags:
            line = _EXPRESSION.match(raw, int(ends[last])).group(1).decode("utf-8", "replace")
            source, value = read_expression(line)
            yield {"kind": "tag", "source": source, "form": value and value.form, "labels": sorted({*value.labels}) if value else [], "freedom": value and value.freedom}

    @staticmethod
    def _joined(words: list[bytes], finds: list) -> Iterator[dict]:
        """Statements of notices: of those that overlap the first and longest counts; joined ones are one expression."""
        chosen: list[tuple[int, int, str, float | None]] = []
        for w, (kind, label, n, freedom) in sorted((f for f in finds if f[1][0] != "tag"), key=lambda f: (f[0], -f[1][2], f[1][1], f[1][0])):
            if not chosen or w >= chosen[-1][1]:
                chosen.append((w, w + n, label, freedom))
        runs: list[list] = []
        for w, end, label, freedom in chosen:
            value = Value(label, 3, () if freedom is None else (label,), freedom)
            if runs:
                between = words[runs[-1][1] : w] if w - runs[-1][1] <= GAP else [b"too far"]
                joins = [x for x in between if x in _JOINS]
                if len(joins) == 1 and all(x in _SMALL or x in _JOINS or x.isdigit() for x in between):
                    runs[-1][1] = end
                    runs[-1][2] += [joins[0].decode(), value]
                    continue
            runs.append([w, end, [value]])
        for w, end, parts in runs:
            value = evaluated(parts)
            source = b" ".join(words[w:end]).decode("utf-8", "replace")
            yield {"kind": "notice", "source": source, "form": value and value.form, "labels": sorted({*value.labels}) if value else [], "freedom": value and value.freedom}


def _latin(phrase: str) -> str:
    return " ".join(phrase.split()).encode().decode("latin-1")


FINDS = "array<struct<kind:string,label:string,word:bigint,n_words:int>>"
STATEMENTS = "array<struct<kind:string,source:string,form:string,labels:array<string>,freedom:double>>"
_FIND = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int32())]))
_STATEMENT = pa.list_(pa.struct([("kind", pa.string()), ("source", pa.string()), ("form", pa.string()), ("labels", pa.list_(pa.string())), ("freedom", pa.float64())]))


def scan_licenses(docs: DataFrame, keep: Sequence[str] = ("doc_id",), base: Mapping[str, str] = BASE, notices: Mapping[str, tuple[str, float | None]] = NOTICES) -> DataFrame:
    """``(*keep, n_words, finds, statements)`` of every row of ``docs(*keep, text)``.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. ``finds`` are all places
    where a phrase's words stand consecutively, overlapping ones too, by word: ``(kind, label, word, n_words)`` with
    kind ``base``, ``notice`` or ``exception``. ``statements`` are expressions, first those behind tags and then those of notices:
    ``(kind, source, form, labels, freedom)``, where ``form`` and ``freedom`` are null if the source is no expression
    of known licences. A null text counts as empty: 0 words, no finds. Texts are read whole, however long; repeated
    rows give repeated results; an empty table gives no rows; kept columns may have any name, but those of the
    results give way to them.
    """
    base, notices = dict(base), dict(notices)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = held_by_worker(("licences", tuple(base.items()), tuple(notices.items())), lambda: Scanner(base, notices))
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], _FIND), pa.array([f[2] for f in found], _STATEMENT)]
            yield pa.RecordBatch.from_arrays(columns, ["kept", "n_words", "finds", "statements"])

    rows = carried(docs, keep, F.coalesce("text", F.lit("")).alias("text"))
    kept = rows.schema["kept"].dataType.simpleString()
    return restored(rows.mapInArrow(scanned, f"kept {kept}, n_words long, finds {FINDS}, statements {STATEMENTS}"))


def stated(finds: Column, statements: Column) -> Column:
    """How surely a text states a licence, from 0 (nothing found) to 1: what each label's best sign leaves open is multiplied."""
    weight = lambda f: F.when(f.n_words >= 3, SURE["long"]).otherwise(SURE["short"])
    signs = F.concat(
        F.transform(F.filter(finds, lambda f: f.kind != "exception"), lambda f: F.struct(f.label.alias("label"), (1 - weight(f)).alias("open"))),
        F.transform(
            F.filter(statements, lambda s: s.kind == "tag"),
            lambda s: F.struct(F.coalesce(s.form, F.lit("")).alias("label"), F.when(s.form.isNull(), 1 - SURE["broken"]).otherwise(1 - SURE["tag"]).alias("open")),
        ),
    )
    ordered = F.array_sort(signs)  # of equal labels the surest stands first
    left = F.aggregate(
        ordered,
        F.struct(F.lit(1.0).alias("open"), F.lit(None).cast("string").alias("last")),
        lambda acc, s: F.struct(F.when(acc.last.eqNullSafe(s.label), acc.open).otherwise(acc.open * s.open).alias("open"), s.label.alias("last")),
        lambda acc: acc.open,
    )
    return 1 - left


def freedom(finds: Column, statements: Column) -> Column:
    """How freely all statements of a text together let it be used (the least of them); null where none can be evaluated."""
    return F.array_min(F.transform(statements, lambda s: s.freedom))
