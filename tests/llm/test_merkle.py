"""Merkle trees against plain hashing: any group size, recursion, proofs, tampering, odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ticklake.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def items(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes):
    """(root, proof parts of each node as (left, right) lists)."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k in range(len(run)):
                for i in owners[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            held.append([i for part in owners[at : at + 16] for i in part])
        nodes, owners = above, held
    return nodes[0], paths


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> the result as a counter of tuples."""
    if not rows:
        return Counter()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r, sha(items(r))))
    trees = {}
    for source, held in groups.items():
        held.sort(key=lambda e: (e[0][0] is not None, e[0][0] or 0, e[1]))
        trees[source] = climb([h for _, h in held])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = climb([trees[s][0] for s in order])
    out = Counter()
    for place, source in enumerate(order):
        subroot, paths = trees[source]
        for (row, leaf), path in zip(groups[source], paths):
            path = path + tops[place]
            start = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                lower = None if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                start = sha(items([*row[:4], lower]))
            proof = sha("".join(a + b for a, b in path))
            for a, b in path:
                start = sha(a + start + b)
            out[(row[0], leaf, subroot, root, proof, start, start == root)] += 1
    return out


def check(spark, rows, levels=merkle.LEVELS):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumn("leaf", F.lit("x")).withColumn("root", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("path", F.lit("p"))
    got = queries.verified_proofs(df, levels).collect()
    assert Counter(map(tuple, got)) == plain(rows)
    return got


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_groups_of_any_size(spark, levels):
    rows = []
    for size in (1, 2, 15, 16, 17, 255, 256, 257, 273, 700):
        rows += [(1000 * size + 7 * i, f"s{size}", "en", i, f"Text {i} of {size}") for i in range(size)]
    out = check(spark, rows, levels)
    assert {r.verified for r in out} == {True, False}


def test_many_groups(spark):
    rows = [(i, f"s{i % 290}", "en", i, f"row {i}") for i in range(700)]
    out = check(spark, rows)
    assert all(r.verified for r in out)  # no capitals, so nothing is changed by lower-casing


def test_one_row_and_no_rows(spark):
    got = check(spark, [(3, None, None, None, None)])
    assert got[0].leaf == got[0].root == got[0].folded_root and got[0].proof_sha256 == sha("")
    check(spark, [])


def test_odd_rows(spark, odd_rows):
    rows = [(d, s, la, None if t is None else len(t), t) for d, t, la, s in odd_rows]
    rows += [(None, "b", None, 3, "ÄÖ A"), (None, "b", None, 3, "ÄÖ A"), (None, None, "", 0, ""), (8, "é", "x", 1, "Z" * 100_000)]
    check(spark, rows)


def test_paths_and_the_stored_form(spark):
    rows = [(i, "a" if i % 3 else "b", f"v{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "k long, g string, v string").withColumn("_leaf", merkle.leaf(["k", "v"]))
    proofs = merkle.proofs(df.select("g", "k", "_leaf"), "g", "k").collect()
    assert len(proofs) == 900 and len({r.root for r in proofs}) == 1
    for r in proofs[::37]:
        node = r.leaf
        for p in r.path:
            assert len(p.left) % 64 == len(p.right) % 64 == 0
            node = sha(bytes(p.left).decode() + node + bytes(p.right).decode())
        assert node == r.root and r.leaf == sha(items([r.k, f"v{r.k}"]))
    stored = merkle.manifest(df.select("g", "k", "_leaf"), "g", "k").collect()
    assert {(r.g, r.subroot) for r in stored} == {(r.g, r.subroot) for r in proofs}
    for r in stored:
        assert len(r.level0) == 64 * len(r["keys"]) and r["keys"] == sorted(r["keys"])
        assert r.level1 == "".join(sha(r.level0[i : i + 1024]) for i in range(0, len(r.level0), 1024))
        assert r.top == r.level2 == sha(r.level1)
