import random
import zlib
from hashlib import sha256

import pytest

from factlake.llm import merkle
from factlake.llm.queries import op12_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, pos string"


def h(x):
    return sha256(x.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def up(nodes):
    """Levels of a tree: each a list of digests, up to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    for nodes in levels[:-1]:
        run = at - at % 16
        yield nodes[run:at], nodes[at + 1 : run + 16]
        at //= 16


def brute(rows):
    """Every row's (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: up([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    top = up([own[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for at, (_, _, digest, row) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]) if tampered else row[4]
            folded, proof = leaf((*row[:4], text)), ""
            for left, right in [*siblings(own[s], at), *siblings(top, k)]:
                proof += "".join(left + right)
                folded = h("".join([*left, folded, *right]))
            yield row[0], digest, own[s][-1][0], top[-1][0], h(proof), folded, folded == top[-1][0]


def rows(sizes, seed=1):
    rng = random.Random(seed)
    made = []
    for k, n in enumerate(sizes):
        source = None if k == 0 else ["é", "Z", "a", "", "日本"][k % 5] + str(k // 5 or "")
        made += [(rng.randrange(10**6), source, rng.choice(["en", None]), rng.randrange(9), rng.choice([None, "", "Ab É", "abc"]), "t", "d", "p") for _ in range(n)]
    return made


@pytest.mark.parametrize("sizes", [[0, 5], [0, 1], [1], [17], [1, 1, 2, 16, 17, 33, 257], [3] + [1] * 40, [300, 70, 1]])
@pytest.mark.parametrize("depth", [1, 3])
def test_brute_force(spark, tmp_path, monkeypatch, sizes, depth):
    monkeypatch.setattr(merkle.merkle_manifest, "__defaults__", (*merkle.merkle_manifest.__defaults__[:-1], depth))  # small blocks have several levels of them
    made = rows(sizes)
    made += made[:3] + [(None, *r[1:]) for r in made[:2]]
    spark.createDataFrame(made, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_merkle_manifest(spark, str(tmp_path)).drop("position").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(made)))


def test_open_tree_extends_witnesses():
    digests = [h(str(i)) for i in range(600)]
    tree, witnesses = merkle.OpenTree(3), [merkle.Path() for _ in digests]
    for d, w in zip(digests, witnesses):
        tree.append(d.encode(), w)
    early = [x.copy() for x in witnesses[0].levels]
    assert early[0] == [b"", "".join(digests[1:16]).encode()] and len(early) == 3  # two levels are whole, the third waits
    levels = up(digests)
    assert tree.finish().decode() == levels[-1][0] and sum(map(len, tree.runs)) == 1
    for at in (0, 15, 16, 255, 256, 599):
        assert [tuple(x) for x in witnesses[at].levels] == [("".join(a).encode(), "".join(b).encode()) for a, b in siblings(levels, at)]


def test_nothing_claimed_and_an_empty_table(spark):
    docs = spark.createDataFrame(rows([20, 3]), SCHEMA)
    assert all(r["verified"] for r in merkle.merkle_manifest(docs).collect())
    assert merkle.merkle_manifest(docs.limit(0)).count() == 0
