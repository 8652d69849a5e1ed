"""Exact top-k against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest

from ticklake.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, label int, g int, page int, score double"


def brute(rows, k, scale=64.0, every=20):
    points = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        points.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    asked = {}
    for i, v in points:
        if i % every == 0:
            raw = np.array(v, dtype="<f8").tobytes()
            asked[i] = min(asked.get(i, (raw, v)), (raw, v), key=lambda x: x[0])
    out = []
    for i, (_, q) in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in points if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, k=20, **options):
    frame = spark.createDataFrame([(i, v, 0, 1, 2, 0.5) for i, v in rows], SCHEMA)
    got = mtree.top_k(frame, lambda vec_id: vec_id % 20 == 0, k=k, **options).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, k)


def test_embeddings(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(spark, rows, page=64, pivots=8)


def test_clusters_and_ties(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.05 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # many equal vectors
    rows += [(2000 + i, [0.0] * 8) for i in range(30)]
    check(spark, rows, k=7, page=32, pivots=16)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (20, [0.5, -0.25]), (20, [0.5, -0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]),
        (4, [float("inf"), 0.0]), (5, []), (6, [1.0]), (7, [0.1, 0.2, 0.3]), (None, [1.0, 1.0]), (40, None), (8, [1.0, 2.0]),
        (8, [1.0, 2.0]), (-20, [-1.0, -2.0]),
    ]
    check(spark, rows)
    check(spark, rows, k=2, page=2)


def test_large_components(spark):
    rows = [(20 * i, [float(10.0**i), -3.0 * i, 2.0e7]) for i in range(8)] + [(7, [1.0e7, 1.0e7, 1.0e7])]
    check(spark, rows)


def test_no_rows(spark):
    check(spark, [])
    check(spark, [(1, [1.0])])
    check(spark, [(20, [1.0])])


def test_bounds_hold_and_skip_work():
    rng = np.random.default_rng(4)
    x = np.floor(64 * np.concatenate([c + 0.02 * rng.normal(size=(200, 16)) for c in rng.normal(size=(10, 16))]))
    table = pa.table({
        "vec_id": np.arange(len(x)), "vec": pa.array([r.tobytes() for r in x], pa.binary()),
        "g": pa.array([0] * len(x), pa.int32()), "cell": pa.array([0] * len(x), pa.int64()),
        "part": pa.array([0] * len(x), pa.int32()),
    })
    node = mtree._node(table).to_pylist()[0]
    starts, radii = np.frombuffer(node["leaves"], "<i4"), np.frombuffer(node["radii"], "<f8")
    held = np.frombuffer(node["vecs"], "<f8").reshape(len(x), -1)
    for k in range(len(radii)):
        leaf = held[starts[k] : starts[k + 1]]
        assert mtree.distances(leaf, leaf[0]).max() <= radii[k] + 1e-9
    multiplied = 0
    real = mtree.products

    def counted(q, rows):
        nonlocal multiplied
        multiplied += len(q) * len(rows)
        return real(q, rows)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mtree, "products", counted)
        q = x[:50]
        best, found = mtree.search(node, np.arange(50), q, np.full(50, mtree.NOTHING + 1), 5)
    scores = (q @ x.T).astype(int)
    scores[np.arange(50), np.arange(50)] = np.iinfo(np.int64).min
    want = np.sort(scores, axis=1)[:, ::-1][:, :5]
    assert (best == want).all() and multiplied < 0.5 * 50 * len(x)


def test_pages_are_metric_nodes_that_queries_skip(spark, monkeypatch):
    # clusters inside clusters: cells are split more than once, and most pages cannot hold a query's best rows
    rng = np.random.default_rng(6)
    x = np.concatenate([8 * c + 1.5 * np.repeat(rng.normal(size=(8, 10)), 25, axis=0) + 0.05 * rng.normal(size=(200, 10)) for c in rng.normal(size=(6, 10))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x[rng.permutation(len(x))])]
    rows += [(5000 + i, rows[0][1]) for i in range(150)]  # equal vectors fill pages of their own
    kept, real = {}, mtree.cut

    def watched(df, label="cut"):
        out = real(df, label)
        kept.setdefault(label, []).append(out)
        return out

    monkeypatch.setattr(mtree, "cut", watched)
    check(spark, rows, k=5, page=40, pivots=4)
    nodes = kept["nodes"][0].collect()
    assert len(nodes) > 30 and max(len(n["ids"]) // 8 for n in nodes) <= 60
    assert len(kept["routed"]) >= 3 and max(n["cell"] for n in nodes) > 257**2  # two levels below the root
    root_of = {}
    for n in nodes:
        held = np.frombuffer(n["vecs"], "<f8").reshape(-1, n["dim"])
        centre = np.frombuffer(n["centre"], "<f8")
        assert mtree.distances(held, centre).max() <= n["radius"] + 1e-9
        root_of.setdefault(n["g"], []).append(n["parent"])
    queries = kept["queries"][0].count()
    visits = sum(w.count() for w in kept["wanted"])
    assert visits < 0.5 * queries * len(nodes)


def test_page_bounds_never_lose_a_row():
    rng = np.random.default_rng(7)
    for _ in range(20):
        root, q = np.floor(40 * rng.normal(size=6)), np.floor(40 * rng.normal(size=(9, 6)))
        held = [np.floor(40 * rng.normal(size=6) + 6 * rng.normal(size=(12, 6))) for _ in range(7)]
        pages = {
            "centres": np.array([x[0] for x in held]), "radii": np.array([mtree.distances(x, x[0]).max() for x in held]),
            "parents": np.array([mtree.distances(x[:1], root)[0] for x in held]),
        }
        best = np.array([[(x @ v).max() for x in held] for v in q])
        least = np.sort(best, axis=1)[:, -3]
        reach = mtree.page_bounds(q, root, pages, least)
        assert reach[best >= least[:, None]].all()
