"""Exact top-k inner products by best-first search in a paged M-tree.

Vectors are compared by Euclidean distance for the tree and ranked by inner product: in a ball around
c with radius r no product exceeds q.c + |q| r, which is the bound of a node; the distance of a child's
centre from its parent's, stored when the tree is built, bounds q.c itself without computing it.

Levels: up to ``PIVOTS`` routing vectors (root), each with the rows nearest to it. A cell with more rows than a page is
split by routing vectors of its own, drawn from its rows, and so on until a cell fits a page; rows that cannot be parted
(equal vectors) are dealt to pages by number. A page is one row of the node table: a metric node with its
centre, covering radius and distance from its root vector, and below it leaves around rows chosen farthest first,
with their centres, radii and distances from the page's centre, and the vectors with theirs from their leaf's.

Search: queries go in blocks to the page that holds them, which gives each a score that its k-th best cannot
fall below (queries of pages with too few rows look at the pages of their root vector). Then a query is tested against
the root vectors, and against the pages of those whose bound reaches its score: first by the page's stored
distance from its root vector, which needs no product, then by its centre and radius. Only pages that pass are
joined. In a page, leaves are visited in the order of their bounds as long as these reach the query's k-th
score so far; in a leaf, rows whose own bound falls short are not multiplied.

The root (at most ``PIVOTS`` vectors, radii and counts) is all the driver sees. Blocks, pages and lists of pages have a
bounded number of rows and meet by equi-joins, which adaptive execution splits where many rows share a page.

Scores are exact: products are summed as doubles while they stay below 2^53, else as Python integers,
limited to 64 bits. Edge cases: of rows that repeat a query's id, the one with the smallest vector asks; a null vector, or one with a null or non-finite component, takes no
part, nor does a null id; vectors of different length are compared as if padded with zeros; rows with
the query's own id are no candidates of it; repeated rows are candidates of their own; with fewer
candidates than k all are returned; no queries or no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklake.session import cut

K, PAGE, PIVOTS, BLOCK = 20, 2048, 256, 256
#: Rows that are split in one go, pages whose bounds are tested in one go, and levels of cells at most.
CHUNK, LISTED, LEVELS = 8192, 1024, 6
NOTHING = np.iinfo(np.int64).min
_SLACK = 1e-9

POINT = "vec_id long, vec binary"
ROUTED = "vec_id long, vec binary, g int, cell long, d double"
NODE = (
    "g int, cell long, part int, ids binary, vecs binary, dim int, leaves binary, radii binary, parents binary, dists binary, "
    "centre binary, radius double, parent double"
)


def _matrix(rows: list[bytes], dim: int | None = None) -> np.ndarray:
    """Vectors as a matrix, short ones padded with zeros."""
    sizes = [len(r) // 8 for r in rows]
    dim = max([dim or 0, *sizes])
    if all(n == dim for n in sizes):
        return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), dim)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : sizes[i]] = np.frombuffer(r, "<f8")
    return out


def _wide(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of integral rows."""
    if not (q.size and x.size):
        return np.zeros((len(q), len(x)), dtype=np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q) @ whole(x).T
    return np.clip(exact, NOTHING + 1, np.iinfo(np.int64).max).astype(np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of x from c, rounded up a little."""
    return np.sqrt(((x - c) ** 2).sum(axis=1)) * (1 + _SLACK)


def _points(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            values = vectors.values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
            edges = vectors.offsets.to_numpy()
            known = np.logical_and(vectors.is_valid().to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            with np.errstate(all="ignore"):
                whole = np.floor(scale * values)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(whole))])
            known &= odd[edges[1:]] == odd[edges[:-1]]
            keep = np.flatnonzero(known)
            raw = (whole + 0.0).astype("<f8").tobytes()
            rows = [raw[8 * a : 8 * b] for a, b in zip(edges[:-1][keep].tolist(), edges[1:][keep].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(rows, pa.binary())], ["vec_id", "vec"])

    return run


def points(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, vec): components as floor(scale * x), stored as doubles."""
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return source.mapInArrow(_points(scale), POINT)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, distance from it) of each row; the first of equally near ones."""
    nearest, least = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.inf)
    for g, c in enumerate(centres):
        d = distances(x, c)
        closer = d < least
        nearest[closer], least[closer] = g, d[closer]
    return nearest, least


def _routed(pivots: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            if not rows:
                continue
            x = _matrix(rows, max(len(p) // 8 for p in pivots))
            nearest, least = _nearest(x, _wide(_matrix(pivots), x.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nearest), pa.array(nearest.astype(np.int64) + 1), pa.array(least)],
                ["vec_id", "vec", "g", "cell", "d"],
            )

    return run


def _split(rows: pa.Table, seeds: pa.Table) -> pa.Table:
    """Rows of one cell, dealt to the nearest of its routing vectors."""
    if not rows.num_rows or not seeds.num_rows:
        return rows.select(["vec_id", "vec", "g", "cell", "d"]).slice(0, 0)
    pivots = seeds["seeds"][0].as_py()
    x = _matrix(rows["vec"].to_pylist(), max(len(p) // 8 for p in pivots))
    nearest, least = _nearest(x, _wide(_matrix(pivots), x.shape[1]))
    cell = rows["cell"].to_numpy() * (PIVOTS + 1) + nearest + 1
    return pa.table(
        {"vec_id": rows["vec_id"], "vec": rows["vec"], "g": rows["g"], "cell": pa.array(cell, pa.int64()), "d": pa.array(least)}
    )


def _cells(routed: DataFrame, page: int) -> DataFrame:
    """Split cells with more rows than a page, level by level, by routing vectors drawn from their own rows."""
    for level in range(LEVELS):
        sizes = routed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius"))
        over = cut(sizes.where((F.col("n") > page) & (F.col("radius") > 0)), "over")
        many = F.least(F.ceil(F.col("n") / F.lit(page)), F.lit(PIVOTS))
        # A part of the different vectors, by hash: some eight times as many as are wanted.
        hashed = F.xxhash64("vec", F.lit(level))
        drawn = F.pmod(hashed, F.lit(1 << 30)) <= (8 * many / F.col("n") * F.lit(1 << 30))
        sample = routed.join(over, "cell").where(drawn).select("cell", "vec", many.alias("many"), "n").distinct()
        order = Window.partitionBy("cell").orderBy(F.xxhash64("vec", F.lit(level)), "vec")
        chosen = sample.withColumn("i", F.row_number().over(order)).where(F.col("i") <= F.col("many"))
        seeds = chosen.groupBy("cell").agg(F.sort_array(F.collect_list("vec")).alias("seeds"), F.min("n").alias("n"))
        seeds = cut(seeds.where(F.size("seeds") > 1), "seeds")
        if seeds.isEmpty():
            break
        chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("long")
        each = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
        right = seeds.select("cell", "seeds", each.alias("chunk"))
        dealt = routed.join(seeds.select("cell", chunks.alias("chunks")), "cell")
        left = dealt.withColumn("chunk", F.pmod(F.monotonically_increasing_id(), F.col("chunks"))).drop("chunks")
        split = left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInArrow(_split, ROUTED)
        rest = routed.join(seeds.select("cell"), "cell", "left_anti").select("vec_id", "vec", "g", "cell", "d")
        routed = cut(split.unionByName(rest), "routed")
    return routed


def _nodes(root: list[bytes]):
    """Pages with their distance from their root vector."""
    return lambda table: _node(table, root)


def _node(table: pa.Table, root: list[bytes] | None = None) -> pa.Table:
    """Build a page: leaves around rows that are chosen farthest first."""
    table = table.sort_by([("vec_id", "ascending")])
    x = _matrix(table["vec"].to_pylist())
    ids = table["vec_id"].to_numpy()
    n = len(x)
    seeds, least, leaf = [0], distances(x, x[0]), np.zeros(n, dtype=np.int64)
    for number in range(1, int(np.ceil(np.sqrt(n)))):
        far = int(np.argmax(least))
        if not least[far] > 0:
            break  # all rows equal one of the seeds
        seeds.append(far)
        d = distances(x, x[far])
        closer = d < least
        leaf[closer], least[closer] = number, d[closer]
    # a leaf's own seed stands first in it
    first = np.ones(n, dtype=bool)
    first[seeds] = False
    order = np.lexsort((ids, first, leaf))
    starts = np.searchsorted(leaf[order], np.arange(len(seeds) + 1))
    radii = np.array([least[leaf == k].max() for k in range(len(seeds))])
    parents = distances(x[seeds], x[0])
    g, dim = table["g"][0].as_py(), x.shape[1]
    own = np.frombuffer(root[g], "<f8") if root else x[0]
    dim = max(dim, len(own))
    row = {
        "g": g,
        "cell": table["cell"][0].as_py(),
        "part": table["part"][0].as_py(),
        "ids": ids[order].astype("<i8").tobytes(),
        "vecs": x[order].astype("<f8").tobytes(),
        "dim": x.shape[1],
        "leaves": starts.astype("<i4").tobytes(),
        "radii": radii.astype("<f8").tobytes(),
        "parents": parents.astype("<f8").tobytes(),
        "dists": least[order].astype("<f8").tobytes(),
        "centre": x[0].astype("<f8").tobytes(),
        "radius": float(distances(x, x[0]).max()),
        "parent": float(distances(_wide(x[:1], dim), _wide(own[None, :], dim)[0])[0]),
    }
    kinds = {"g": pa.int32(), "cell": pa.int64(), "part": pa.int32(), "dim": pa.int32(), "radius": pa.float64(), "parent": pa.float64()}
    return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})


def search(node: dict, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's best rows of a page, k columns; empty places have score NOTHING.

    ``least`` is a score that a row must reach to matter.
    """
    names = np.frombuffer(node["ids"], "<i8")
    dim = max(node["dim"], q.shape[1])
    x = _wide(np.frombuffer(node["vecs"], "<f8").reshape(len(names), node["dim"]), dim)
    q = _wide(q, dim)
    starts = np.frombuffer(node["leaves"], "<i4")
    radii, parents, dists = (np.frombuffer(node[c], "<f8") for c in ("radii", "parents", "dists"))
    norms = np.sqrt((q * q).sum(axis=1)) * (1 + _SLACK)
    best = np.full((len(q), k), NOTHING, dtype=np.int64)
    found = np.zeros((len(q), k), dtype=np.int64)
    slack = _SLACK * (1 + norms * (np.abs(x).max(initial=0.0) * np.sqrt(max(dim, 1))))

    def reaches(bound: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        kth = np.maximum(best[rows, -1], least[rows]).astype(np.float64)
        return bound + (slack[rows] if bound.ndim == 1 else slack[rows][:, None]) >= (kth if bound.ndim == 1 else kth[:, None])

    # By stored distances from the page's centre alone: leaves that no query can need are not looked at.
    middle = q @ x[0] if len(x) else np.zeros(len(q))
    wanted = np.flatnonzero(reaches(middle[:, None] + norms[:, None] * (parents + radii)[None, :]).any(axis=0))
    bounds = q @ x[starts[wanted]].T + norms[:, None] * radii[wanted][None, :]
    for at in np.argsort(-bounds.max(axis=0, initial=-np.inf), kind="stable"):
        rows = np.flatnonzero(reaches(bounds[:, at]))
        if not len(rows):
            continue
        leaf = slice(starts[wanted[at]], starts[wanted[at] + 1])
        centre = bounds[rows, at] - norms[rows] * radii[wanted[at]]
        near = reaches(centre[:, None] + norms[rows][:, None] * dists[leaf][None, :], rows).any(axis=0)
        held, own = x[leaf][near], names[leaf][near]
        scores = products(q[rows], held)
        scores[ids[rows][:, None] == own[None, :]] = NOTHING
        scores[scores < least[rows][:, None]] = NOTHING
        both = np.concatenate([best[rows], scores], axis=1)
        who = np.concatenate([found[rows], np.broadcast_to(own, scores.shape)], axis=1)
        order = np.lexsort((who, ~both), axis=1)[:, :k]
        best[rows] = np.take_along_axis(both, order, axis=1)
        found[rows] = np.take_along_axis(who, order, axis=1)
    return best, found


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, least = np.array(row["qids"], dtype=np.int64), np.array(row["least"], dtype=np.int64)
                best, found = search(row, ids, _matrix(row["qvecs"]), least, k)
                query, place = np.nonzero(best > NOTHING)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[query]), pa.array(found[query, place]), pa.array(best[query, place])],
                    ["query_id", "vec_id", "score"],
                )

    return run


def _blocks(queries: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, qids, qvecs, least): blocks of about ``block`` queries of one page or root vector."""
    counts = queries.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("many"))
    dealt = queries.join(counts, keys).withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.col("many")))
    one = F.collect_list(F.struct("vec_id", "vec", "least", "own"))
    grouped = dealt.groupBy(*keys, "deal").agg(one.alias("qs"))
    names = {"vec_id": "qids", "vec": "qvecs", "least": "least", "own": "own"}
    return grouped.select(*keys, *[F.col(f"qs.{c}").alias(n) for c, n in names.items()])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, numbered from 1; Spark limits each query's rows before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _reached(pivots: list[bytes], radii: list[float]):
    """Queries with the routing vectors whose bound reaches their score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            if not rows:
                continue
            q = _matrix(rows, max(len(p) // 8 for p in pivots))
            centres = _wide(_matrix(pivots), q.shape[1])
            least = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            norms = np.sqrt((q * q).sum(axis=1)) * (1 + _SLACK)
            bounds = q @ centres.T + norms[:, None] * np.array(radii)[None, :]
            reach = bounds + _slack(norms, centres)[:, None] >= least[:, None]
            reach &= np.array(radii)[None, :] >= 0  # routing vectors without rows
            query, g = np.nonzero(reach)
            pick = pa.array(query)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.astype(np.int32)), *[batch.column(i).take(pick) for i in range(4)]], ["g", "vec_id", "vec", "least", "own"]
            )

    return run


def _slack(norms: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What rounding may take from a bound."""
    return _SLACK * (1 + norms * (np.abs(x).max(initial=0.0) * np.sqrt(max(x.shape[1], 1))))


def page_bounds(q: np.ndarray, root: np.ndarray, pages: dict, least: np.ndarray) -> np.ndarray:
    """Which queries (rows) may find their score in which pages (columns) of a root vector.

    ``pages`` has their centres, radii and distances from the root vector. A page that fails by its distance for all
    queries is not multiplied.
    """
    norms = np.sqrt((q * q).sum(axis=1)) * (1 + _SLACK)
    slack = (_slack(norms, np.concatenate([pages["centres"], root[None, :]])) - least)[:, None]
    far = (q @ root)[:, None] + norms[:, None] * (pages["parents"] + pages["radii"])[None, :] + slack >= 0
    near = np.flatnonzero(far.any(axis=0))
    out = np.zeros(far.shape, dtype=bool)
    exact = q @ pages["centres"][near].T + norms[:, None] * pages["radii"][near][None, :]
    out[:, near] = far[:, near] & (exact + slack >= 0)
    return out


def _pages_reached(root: list[bytes]):
    """Blocks of queries met with a list of pages of their root vector -> (cell, part, query) for pages that may matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pages, centre = row["pages"], np.frombuffer(root[row["g"]], "<f8")
                centres = _matrix([p["centre"] for p in pages], max(len(v) // 8 for v in [*row["qvecs"], root[row["g"]]]))
                q = _wide(_matrix(row["qvecs"]), centres.shape[1])
                about = {
                    "centres": centres,
                    "radii": np.array([p["radius"] for p in pages]),
                    "parents": np.array([p["parent"] for p in pages]),
                }
                least = np.array(row["least"], dtype=np.float64)
                reach = page_bounds(q, _wide(centre[None, :], centres.shape[1])[0], about, least)
                # The page that holds a query was its first.
                names = np.array([p["name"] for p in pages])
                reach &= np.array([o or "" for o in row["own"]])[:, None] != names[None, :]
                query, page = np.nonzero(reach)
                pick = lambda values, kind: pa.array([values[j] for j in query.tolist()], kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([pages[j]["cell"] for j in page.tolist()], pa.int64()),
                        pa.array([pages[j]["part"] for j in page.tolist()], pa.int32()),
                        pick(row["qids"], pa.int64()),
                        pick(row["qvecs"], pa.binary()),
                        pick(row["least"], pa.int64()),
                        pick(row["own"], pa.string()),
                    ],
                    ["cell", "part", "vec_id", "vec", "least", "own"],
                )

    return run


QUERY = "vec_id long, vec binary, least long, own string"


def top_k(
    embeddings: DataFrame, is_query: Callable[[Column], Column], k: int = K, scale: float = 64.0, page: int = PAGE, pivots: int = PIVOTS
) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score for the rows whose id ``is_query`` accepts."""
    spark = embeddings.sparkSession
    held = points(embeddings, scale)
    n = held.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # The root: a bounded number of different vectors, spread by their hash.
    many = min(pivots, -(-n // page))
    root = [r["vec"] for r in held.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(many).collect()]
    routed = cut(held.mapInArrow(_routed(root), ROUTED), "routed")
    radii = [-1.0] * len(root)
    for r in routed.groupBy("g").agg(F.max("d").alias("radius")).collect():  # a row per routing vector
        radii[r["g"]] = r["radius"]

    # Pages: cells, and parts of cells whose rows cannot be told apart.
    routed = _cells(routed, page)
    parts = routed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(page)).cast("int").alias("parts"))
    dealt = routed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    paged = cut(dealt.select("vec_id", "vec", "g", "cell", "part"), "paged")
    nodes = cut(paged.groupBy("cell", "part").applyInArrow(_nodes(root), NODE), "nodes")
    name = F.concat_ws("/", "cell", "part").alias("name")
    listed = nodes.select("g", "cell", "part", name, "centre", "radius", "parent")
    lists = listed.join(listed.groupBy("g").agg(F.ceil(F.count("*") / F.lit(LISTED)).alias("lists")), "g")
    lists = lists.withColumn("list", F.pmod(F.xxhash64("cell", "part"), F.col("lists")))
    pages = cut(lists.groupBy("g", "list").agg(F.collect_list(F.struct("cell", "part", "name", "centre", "radius", "parent")).alias("pages")), "pages")

    # One query per id: of repeated ids the smallest vector asks.
    asked = paged.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("vec", "g", "cell", "part")).alias("q"))
    queries = asked.select("vec_id", "q.vec", "q.g", "q.cell", "q.part").withColumn("own", name)
    start = cut(queries.withColumn("least", F.lit(NOTHING + 1)), "queries")

    def visit(wanted: DataFrame) -> DataFrame:
        met = _blocks(wanted, ["cell", "part"]).join(nodes, ["cell", "part"])
        return met.mapInArrow(_searched(k), "query_id long, vec_id long, score long")

    def reached(wanted: DataFrame) -> DataFrame:
        met = _blocks(wanted, ["g"]).join(pages, "g").select("g", "qids", "qvecs", "least", "own", "pages")
        return cut(met.mapInArrow(_pages_reached(root), f"cell long, part int, {QUERY}"), "wanted")

    def kth(found: DataFrame) -> DataFrame:
        return found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))

    near = cut(_best(visit(start), k), "near")
    few = cut(start.join(kth(near), "vec_id", "left_anti").select("g", "vec_id", "vec", "least", "own"), "few")
    if not few.isEmpty():
        # Too few rows in their page: all pages of their root vector, before the others are bounded.
        more = _best(near.drop("rank").unionByName(visit(reached(few))), k)
        near = cut(more, "near")
    seen = few.select("vec_id", "g").withColumnRenamed("g", "done")
    known = start.drop("least").join(kth(near), "vec_id", "left").select(
        "vec_id", "vec", F.coalesce("least", F.lit(NOTHING + 1)).alias("least"), "own"
    )
    roots = known.mapInArrow(_reached(root, radii), f"g int, {QUERY}").join(seen, "vec_id", "left")
    open_ = roots.where(F.col("done").isNull() | (F.col("done") != F.col("g"))).drop("done")
    far = visit(reached(cut(open_, "roots")))
    return _best(near.drop("rank").unionByName(far), k).select("query_id", "rank", "vec_id", "score")
