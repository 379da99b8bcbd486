import re

import pytest

from factlake.llm import licenses
from factlake.llm.queries import op11_license_scans

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ODD = [
    None, "", "   ", "CC BY", "cc-by CC_BY ccby cc by", "cc by cc by cc by", "ccc by", "cc\nBY-NC\t4.0", "All rights reserved. ALL RIGHTS   RESERVED", "all rights", "GNU General Public License, version 3",
    "Lesser General-Public\x00License", "é cc by é", "cc byé", "İcc by", "cc by", "word " * 3000 + "cc by", "general public license " * 2000, "reserved all rights", "日本 cc by 日本", "cc\x7fby", "CC[BY]",
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nmore",
]


def brute(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_by_brute_force(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(1, "cc by", "x"), (1, "cc by", "x"), (None, "cc by", "x")], "doc_id long, text string, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_license_scans(spark, str(tmp_path)).collect()
    assert len(got) == len(ODD) + 3
    rows = {r["doc_id"]: r for r in got if r["doc_id"] not in (1, None)}
    for i, t in enumerate(ODD):
        if i != 1:
            r = rows[i]
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
            assert {*r["base_labels"].split(",")} - {""} <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert rows[22]["labels"] == "apache-2.0,gpl-2.0-only,mit" and rows[22]["expressions"] == "(mit OR apache-2.0) AND gpl-2.0-only WITH classpath-exception-2.0" and rows[22]["freedom"] == 0.6


@pytest.mark.parametrize(
    "line, form, freedom",
    [
        ("MIT", "mit", 0.9), ("MIT OR GPL-3.0-only", "mit OR gpl-3.0-only", 0.9), ("mit and GPL-3.0-only", "mit AND gpl-3.0-only", 0.3), ("GPL-2.0+", "gpl-2.0-or-later", 0.3),
        ("MIT AND ISC OR GPL-2.0", "mit AND isc OR gpl-2.0", 0.9), ("MIT AND (ISC OR GPL-2.0)", "mit AND (isc OR gpl-2.0)", 0.9), ("((MIT))", "mit", 0.9),
        ("GPL-2.0-only WITH Linux-syscall-note OR SSPL-1.0", "gpl-2.0-only WITH linux-syscall-note OR sspl-1.0", 0.6), ("LicenseRef-Own AND MIT", "licenseref-own AND mit", 0.0),
        ("MIT This file is free", "mit", 0.9), ("Apache-2.0 */", "apache-2.0", 0.9), ("MIT)", "mit", 0.9), ("MIT OR", None, None), ("(MIT", None, None), ("OR MIT", None, None), ("", None, None),
        ("Nonesuch-1.0", None, None), ("MIT WITH Apache-2.0", None, None), ("(MIT OR ISC) WITH LLVM-exception", None, None), ("LLVM-exception", None, None), ("()", None, None),
    ],
)
def test_expressions(line, form, freedom):
    value = licenses.read_expression(line)[1]
    assert (value and value.form, value and value.freedom) == (form, freedom)


def test_statements_of_notices(spark):
    texts = [
        "Licensed under the MIT License or, at your option, the Apache License, Version 2.0.", "MIT License\nsomething else entirely or the Apache License", "GNU General Public License with Classpath exception",
        "Released under the MIT License.", "nothing here", "spdx-license-identifier: what", "CC BY-NC-SA 4.0",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [r["statements"] for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()]
    assert [[(s["kind"], s["form"], s["freedom"]) for s in r] for r in rows] == [
        [("notice", "mit OR apache", 0.9)], [("notice", "mit", 0.9), ("notice", "apache", 0.9)], [("notice", "gpl WITH classpath-exception", 0.6)],
        [("notice", "mit", 0.9)], [], [("tag", None, None)], [("notice", "cc-by-nc-sa", 0.1)],
    ]


def test_clashing_columns_and_an_empty_table(spark):
    schema = "doc_id long, text string, kept string, finds string, n_words string, label string"
    docs = spark.createDataFrame([(1, "cc by", "a", "b", "c", "d")], schema)
    row = licenses.scan_licenses(docs, keep=["doc_id", "kept", "label", "text"]).collect()[0]
    assert (row["doc_id"], row["kept"], row["label"], row["text"], row["n_words"]) == (1, "a", "d", "cc by", 2)
    row = licenses.scan_licenses(docs, keep=["doc_id", "finds", "n_words"]).collect()[0]
    assert row["n_words"] == 2 and len(row["finds"]) == 1 and len(row) == 4
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
