"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are documents, columns are hashes of n-grams; two rows link if their
overlap, an entry of the product of the matrix with its transpose, is large enough for their sizes.
The product is never formed whole:

1. *Rows.* Documents with the same set are one row (a class, known by a 128-bit sum over its set).
2. *First column block.* A part of all columns, by hash. A row may miss at most ``n - ceil(s * n)`` of
   its own columns in any row it links with, so a row with more columns in this block that no other
   row has is discarded. The part follows from the similarity (``FIRST_BLOCK`` times what a row may miss),
   so that rows without near duplicates mostly end here; the bound is exact for any part.
3. *All columns* of the rows that are left: how many rows share each; columns of a single row go, and
   with them rows that are left with too few.
4. *Overlap lists.* With a row's columns in order of rarity, two linked rows share one of their first
   ``n - ceil(s * n) + 1`` columns (columns of a single row count among them). Each column's rows are
   compared in two steps. First with its most central rows only, a few per column: links found there
   join most rows of a family. Then, tile by tile, rows of different components. Sizes and counts per
   column block (64 blocks by hash) bound the overlap of a pair from above; pairs below what their
   sizes ask for are discarded, the others get their exact overlap.

So every link between rows of different components is found, and the components are exact.

5. *Links.* All links lie inside components. The rows of a component that is more than one tile are dealt by size
   into bands and there into tiles of bounded size. A tile meets those of its own band and of the two beside
   it, once each; further apart the sizes allow no link, so nothing is sent. The exact overlaps of all pairs of rows
   of two tiles are an incidence matrix times the transpose of another, made from blocks of columns. ``join`` counts a document's links there,
   rows weighted by the members of their class; ``links`` lists the pairs of classes.

A common n-gram's list is never in one task: it is combined before it is shuffled, and its rows are
dealt to tiles of ``TILE`` rows, joined by an equi-join that adaptive execution splits.

n-grams are compared by 64-bit hashes of their words (mixed lanes of eight bytes, chained word by word): two
different n-grams meet with probability about 2^-64. Class sums have 128 bits.

Edge cases: words are runs other than ASCII white space, A-Z lower-cased; a document of fewer words
than n has one n-gram, its whole sequence; a null text or one without words has none and is a
component of its own; repeated rows are members of one class; null ids never are a component's id
unless no member has one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.llm.common import join_same
from ticklake.llm.components import components
from ticklake.llm.textblocks import LOWERED, blocks, mix64, span_hashes, words_of_texts
from ticklake.session import cut

WORDS, SIMILARITY = 4, 85
#: Size of the first column block, as a multiple of the part of its columns that a row may miss in a link.
FIRST_BLOCK = 1.5
#: Rows of a tile, central rows per overlap list, and column blocks of the overlap bound.
TILE, HUBS, BINS = 512, 4, 64
#: Columns that the rows of a tile of a component have in all, about, and columns of a block of its product.
TILE_COLUMNS, BLOCK = 1 << 19, 4096
#: Ids up to which the rows to read again are sent to all tasks (8 bytes each).
SMALL_IDS = 500_000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_ONE, _TWO = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def ngrams(raw: np.ndarray, texts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of each text of a block, where each text's start and the end)."""
    low = LOWERED[raw]
    begins, ends = words_of_texts(low, texts)
    hashes = span_hashes(low, begins, ends)
    first = np.searchsorted(begins, texts, side="left")
    count = np.diff(first)
    n = np.maximum(count - words + 1, np.minimum(count, 1))
    edges = np.concatenate([[0], np.cumsum(n)])
    whole = np.flatnonzero(count >= words)
    out = np.empty(edges[-1], dtype=_U)
    if len(hashes) >= words:
        grams = hashes[: len(hashes) - words + 1]
        for k in range(1, words):
            grams = mix64(grams * _STEP + hashes[k : len(hashes) - words + 1 + k])
    for i in whole.tolist():
        part = grams[first[i] : first[i] + n[i]]
        out[edges[i] : edges[i + 1]] = np.sort(part)
    for i in np.flatnonzero((count > 0) & (count < words)).tolist():
        value = mix64(hashes[first[i] : first[i] + 1] ^ _TWO)
        for h in hashes[first[i] + 1 : first[i + 1]]:
            value = mix64(value * _STEP + h)
        out[edges[i]] = value[0]
    text = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[edges]


def _signatures(grams: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each text's set."""
    sums = []
    for salt in (_ONE, _TWO):
        total = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(mix64(grams ^ salt))])
        sums.append(total[edges[1:]] - total[edges[:-1]])
    return np.stack(sums, axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    """A row of fixed-width numbers as one binary value each."""
    width = rows.shape[1] * rows.dtype.itemsize
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))])
    return fixed.cast(pa.binary())


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))


def first_part(similarity: int) -> float:
    """The part of all columns that the first block takes for this similarity in percent."""
    return min(1.0, max(0.02, FIRST_BLOCK * (100 - similarity) / 100))


def _rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, texts in blocks(batch.column(1)):
                grams, edges = ngrams(raw, texts, words)
                ids = batch.column(0).slice(first, len(texts) - 1)
                n = pa.array(np.diff(edges), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, n, _binary(_signatures(grams, edges))], ["doc_id", "n", "cls"])

    return run


def _first_block(words: int, part: float):
    limit = _U(min(int(part * (1 << 63)) * 2, (1 << 64) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, texts in blocks(batch.column(0)):
                grams, edges = ngrams(raw, texts, words)
                sign = np.repeat(_signatures(grams, edges)[:, 0], np.diff(edges))
                here = grams < limit
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[here].view(np.int64)), pa.array(sign[here].view(np.int64))], ["h", "sign"]
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, texts in blocks(batch.column(0)):
                grams, edges = ngrams(raw, texts, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        _binary(_signatures(grams, edges)),
                        pa.array(np.diff(edges), pa.int64()),
                        _lists(grams.view(np.int64), edges),
                    ],
                    ["cls", "n", "grams"],
                )

    return run


def _needed(n: np.ndarray | int, m: np.ndarray | int, similarity: int):
    """The smallest overlap that links sets of these sizes."""
    return -(-(similarity * (n + m)) // (100 + similarity))


def _vectors(similarity: int):
    """Shared columns with their counts -> prefix, counts per block, the columns, and how central the row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, n = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            held = batch.column(2)
            edges = held.offsets.to_numpy().astype(np.int64)
            flat = held.values
            df = flat.field("df").to_numpy(zero_copy_only=False)
            h = flat.field("h").to_numpy(zero_copy_only=False)
            prefixes, ends, bins, columns, weight = [], [0], [], [], []
            for i in range(len(n)):
                mine = slice(edges[i], edges[i + 1])
                cols, counts = h[mine], df[mine]
                alone = int(n[i]) - len(cols)
                length = int(n[i]) - -(-similarity * int(n[i]) // 100) + 1 - alone
                order = np.lexsort((cols, counts))[: max(length, 0)]
                prefixes.append(cols[order])
                ends.append(ends[-1] + len(order))
                own = np.sort(cols.view(_U))
                bins.append(np.bincount((own >> _U(58)).astype(np.int64), minlength=BINS).astype("<u4"))
                columns.append(own.astype("<u8").tobytes())
                weight.append(int(counts.sum() * 1000 // max(int(n[i]), 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    uid,
                    batch.column(1),
                    _lists(np.concatenate([np.empty(0, np.int64), *prefixes]), np.array(ends)),
                    _binary(np.array(bins, dtype="<u4").reshape(-1, BINS)),
                    pa.array(columns, pa.binary()),
                    pa.array(weight, pa.int64()),
                ],
                ["uid", "n", "prefix", "bins", "columns", "weight"],
            )

    return run


def _bounded(similarity: int):
    """Pairs whose counts per column block leave room for the overlap they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, BINS) for i in (4, 5))
            most = np.minimum(x, y).sum(axis=1)
            keep = np.flatnonzero(most >= _needed(n, m, similarity))
            yield batch.select(["a", "b", "n", "m"]).take(pa.array(keep))

    return run


def _exact(similarity: int):
    """Pairs whose exact overlap links them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            left, right = batch.column(4), batch.column(5)
            keep = []
            for i in range(len(n)):
                x, y = np.frombuffer(left[i].as_buffer(), "<u8"), np.frombuffer(right[i].as_buffer(), "<u8")
                both = np.sort(np.concatenate([x, y]), kind="stable")
                if int((both[1:] == both[:-1]).sum()) >= _needed(int(n[i]), int(m[i]), similarity):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _tile_pairs(similarity: int):
    """Candidates of two tiles: rows of different components whose bounds allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = row["x"], row["y"]
                na, nb = np.array(a["n"]), np.array(b["n"])
                ca, cb = np.array(a["comp"]), np.array(b["comp"])
                ua, ub = np.array(a["uid"]), np.array(b["uid"])
                xa, xb = (np.frombuffer(b"".join(t["bins"]), "<u4").reshape(-1, BINS) for t in (a, b))
                low, high = [], []
                for i in range(len(na)):
                    js = np.flatnonzero((cb != ca[i]) & (ub != ua[i]))
                    if len(js):
                        most = np.minimum(xb[js], xa[i]).sum(axis=1)
                        js = js[most >= _needed(na[i], nb[js], similarity)]
                        low.append(np.minimum(ub[js], ua[i]))
                        high.append(np.maximum(ub[js], ua[i]))
                empty = np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([empty, *low])), pa.array(np.concatenate([empty, *high]))], ["a", "b"]
                )

    return run


def _size_fits(n: Column, m: Column, similarity: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * similarity


def _band(similarity: int) -> Column:
    """Bands of sizes a little wider than the ratio that a link allows: it spans two neighbours at most."""
    return F.floor(F.log("n") / F.log(F.lit(100.1 / similarity))).cast("long")


def _verified(pairs: DataFrame, vectors: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that link, by the bound first and then by exact overlap."""

    def sides(found: DataFrame, column: str) -> DataFrame:
        one = vectors.select(F.col("uid").alias("a"), F.col("n"), F.col(column).alias("x"))
        two = vectors.select(F.col("uid").alias("b"), F.col("n").alias("m"), F.col(column).alias("y"))
        return found.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y")

    bounded = sides(pairs, "bins").where(_size_fits(F.col("n"), F.col("m"), similarity))
    likely = cut(bounded.mapInArrow(_bounded(similarity), "a long, b long, n long, m long"), "likely")
    return sides(likely, "columns").mapInArrow(_exact(similarity), "a long, b long")


def _survivors(docs: DataFrame, rows: DataFrame, words: int, similarity: int, part: float) -> DataFrame:
    """(uid, n, grams): a row of each class that the first column block leaves."""
    texts = docs.select("text")
    columns = texts.mapInArrow(_first_block(words, part), "h long, sign long").groupBy("h").agg(
        F.min("sign").alias("sign"), F.max("sign").alias("other")
    )
    alone = columns.where("sign = other").groupBy("sign").agg(F.count("*").alias("alone"))
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    left = classes.withColumn("sign", _sign(F.col("cls"))).join(alone, "sign", "left").where(
        F.coalesce(F.col("alone"), F.lit(0)) * 100 <= F.col("n") * (100 - similarity)
    )
    left = cut(left.select("cls", "doc_id"), "left")
    ids = left.select("doc_id").distinct()
    if left.count() <= SMALL_IDS:
        ids = F.broadcast(ids)
    again = join_same(docs.select("doc_id", "text"), ids, ["doc_id"], "left_semi").select("text")
    sets = again.mapInArrow(_sets(words), "cls binary, n long, grams array<bigint>")
    one = sets.join(left.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
    return cut(one.withColumn("uid", F.monotonically_increasing_id()), "sets")


def _sign(cls: Column) -> Column:
    """The first eight bytes of a class as the number that the column blocks carry."""
    swapped = F.concat(*[F.substring(F.hex(cls), 15 - 2 * i, 2) for i in range(8)])
    high = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def _linked(
    docs: DataFrame, words: int, similarity: int, first_block: float | None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents with class, row and class of each set, shared columns of rows, component of linked rows)."""
    rows = cut(docs.select("doc_id", "text").mapInArrow(_rows(words), "doc_id long, n long, cls binary"), "rows")
    part = first_part(similarity) if first_block is None else first_block
    sets = _survivors(docs, rows, words, similarity, part)

    held = sets.select("uid", F.explode("grams").alias("h"))
    counts = held.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = held.join(counts, "h").groupBy("uid").agg(F.collect_list(F.struct("df", "h")).alias("cols"))
    rich = shared.join(sets.select("uid", "n"), "uid").where(F.size("cols") * 100 >= F.col("n") * similarity)
    schema = "uid long, n long, prefix array<bigint>, bins binary, columns binary, weight long"
    vectors = cut(rich.select("uid", "n", "cols").mapInArrow(_vectors(similarity), schema), "vectors")

    # Overlap lists, then their most central rows against all their rows.
    lists = cut(vectors.select("uid", "n", "weight", F.explode("prefix").alias("h")), "lists")
    hubs = lists.groupBy("h", F.pmod(F.xxhash64("uid"), F.lit(HUBS)).alias("k")).agg(
        F.max(F.struct("weight", "uid", "n")).alias("hub")
    )
    near = lists.join(hubs.select("h", "hub"), "h").where("hub.uid <> uid").where(
        _size_fits(F.col("n"), F.col("hub.n"), similarity)
    )
    pairs = near.select(F.least("uid", "hub.uid").alias("a"), F.greatest("uid", "hub.uid").alias("b")).distinct()
    first = cut(_verified(pairs, vectors, similarity), "links")

    # Rows of different components, in tiles of bounded size.
    joined = components(first)
    known = vectors.select("uid", "n", "bins").join(joined.withColumnRenamed("id", "uid"), "uid", "left")
    known = cut(known.select("uid", "n", "bins", F.coalesce("root", "uid").alias("comp")), "known")
    listed = lists.select("h", "uid").join(known, "uid")
    open_ = listed.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("rows")).where("x <> y")
    tile = F.pmod(F.xxhash64("uid"), F.ceil(F.col("rows") / F.lit(TILE)).cast("long"))
    tiles = (
        listed.join(open_.select("h", "rows"), "h")
        .groupBy("h", _band(similarity).alias("band"), tile.alias("tile"))
        .agg(*[F.collect_list(c).alias(c) for c in ("uid", "n", "comp", "bins")])
    )
    tiles = cut(tiles.select("h", "band", "tile", F.struct("uid", "n", "comp", "bins").alias("x")), "tiles")
    other = tiles.select("h", F.col("band").alias("band2"), F.col("tile").alias("tile2"), F.col("x").alias("y"))
    met = tiles.join(other, "h").where("(band2 = band and tile2 >= tile) or band2 = band + 1")
    late = met.select("x", "y").mapInArrow(_tile_pairs(similarity), "a long, b long").distinct()
    second = cut(_verified(late, vectors, similarity), "links")

    roots = cut(components(first.unionByName(second)).withColumnRenamed("id", "uid"), "roots")
    return rows, sets.select("uid", "cls"), vectors.select("uid", "n", "columns"), roots


def _components(rows: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(cls, component_id) of all classes with n-grams."""
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    rooted = sets.join(roots, "uid").join(classes, "cls")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = rooted.join(smallest, "root").select("cls", "component_id")
    return classes.join(linked, "cls", "left").select("cls", F.coalesce("component_id", "first").alias("component_id"))


def _members(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The documents with what is named by class; those without n-grams are components of their own."""
    whole = rows.where("n > 0").join(named, "cls").withColumnRenamed("n", "n_shingles").drop("cls")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone, allowMissingColumns=True)


def _overlaps(uid: np.ndarray, held: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Columns that each of the rows ``left`` shares with each of ``right``, by blocks of columns."""
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    row = np.repeat(np.arange(len(uid)), [len(x) for x in held])
    _, code, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    row, code = row[count[code] > 1], code[count[code] > 1]
    order = np.argsort(code, kind="stable")
    row, code = row[order], np.cumsum(np.diff(code[order], prepend=-1) > 0) - 1
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, BLOCK):
        part = slice(*np.searchsorted(code, [low, low + BLOCK]))
        here = np.zeros((len(uid), min(BLOCK, int(code[-1]) + 1 - low)), dtype=np.float32)
        here[row[part], code[part] - low] = 1
        total += np.rint(here[left] @ here[right].T).astype(np.int64)
    return total


def _met(similarity: int) -> Callable[[dict], tuple[np.ndarray, np.ndarray, list[dict]]]:
    """Two tiles (or one with itself) -> places of the linked pairs among their rows, and the rows."""

    def run(met: dict) -> tuple[np.ndarray, np.ndarray, list[dict]]:
        rows = met["rows"]
        tile = np.array([r["tile"] for r in rows])
        uid, n = np.array([r["uid"] for r in rows]), np.array([r["n"] for r in rows])
        left, right = np.flatnonzero(tile == met["low"]), np.flatnonzero(tile == met["high"])
        if not len(left) or not len(right):
            return left[:0], right[:0], rows
        both = _overlaps(uid, [np.frombuffer(r["columns"], "<u8") for r in rows], left, right)
        linked = both >= _needed(n[left][:, None], n[right][None, :], similarity)
        if met["low"] == met["high"]:
            linked = np.triu(linked, 1)
        i, j = np.nonzero(linked)
        return left[i], right[j], rows

    return run


def _pairs(similarity: int):
    """The linked pairs of rows."""
    meet = _met(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for met in range(batch.num_rows):
                i, j, rows = meet(batch.slice(met, 1).to_pylist()[0])
                uid = np.array([r["uid"] for r in rows], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uid[i]), pa.array(uid[j])], ["a", "b"])

    return run


def _link_counts(similarity: int):
    """Documents that each row's links lead to, in these tiles."""
    meet = _met(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for met in range(batch.num_rows):
                i, j, rows = meet(batch.slice(met, 1).to_pylist()[0])
                size = np.array([r["members"] for r in rows], dtype=np.int64)
                links = np.zeros(len(rows), dtype=np.int64)
                np.add.at(links, i, size[j])
                np.add.at(links, j, size[i])
                uid = pa.array([r["uid"] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([uid, pa.array(links)], ["uid", "links"])

    return run


def _sent(few: DataFrame) -> DataFrame:
    """A written table with a broadcast hint while it is small by count; beyond that Spark's own choice."""
    return F.broadcast(few) if few.count() <= SMALL_IDS else few


def _meetings(rows: DataFrame, sets: DataFrame, vectors: DataFrame, roots: DataFrame, similarity: int) -> DataFrame:
    """Every pair of tiles of a component whose sizes allow links: (root, low, high, rows). No link is left out."""
    members = rows.where("n > 0").groupBy("cls").agg(F.count("*").alias("members"))
    family = sets.join(roots, "uid").join(members, "cls").select("uid", "root", "members")
    narrow = vectors.select("uid", "n", F.length("columns").alias("bytes"), _band(similarity).alias("band"))
    family = cut(narrow.join(family, "uid"), "family")
    amount = F.greatest(F.count("*") / F.lit(TILE), F.sum("bytes") / F.lit(8 * TILE_COLUMNS))
    # Only components of several tiles are looked up again, so that no row is sent to its component's task.
    large = _sent(cut(family.groupBy("root").agg(amount.alias("amount")).where("amount > 1").select("root"), "large"))
    parts = family.join(large, "root", "left_semi").groupBy("root", "band")
    bands = cut(parts.agg(F.ceil(amount).cast("long").alias("tiles")), "bands")
    below = bands.select("root", (F.col("band") + 1).alias("band"), F.col("tiles").alias("below"))
    above = bands.select("root", (F.col("band") - 1).alias("band"), F.col("tiles").alias("above"))
    around = cut(bands.join(below, ["root", "band"], "left").join(above, ["root", "band"], "left"), "around")
    family = family.join(_sent(around), ["root", "band"], "left")
    family = family.withColumn("band", F.when(F.col("tiles").isNull(), F.lit(0)).otherwise(F.col("band")))
    family = family.withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))

    def number(band: Column, tile: Column) -> Column:
        return F.shiftleft(band, 32) + tile

    def of_band(away: int, tiles: Column) -> Column:
        held = F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda i: number(F.col("band") + away, i))
        return F.when(tiles > 0, held).otherwise(F.array().cast("array<bigint>"))

    met = F.concat(of_band(-1, F.col("below")), of_band(0, F.col("tiles")), of_band(1, F.col("above")))
    tile = number(F.col("band"), F.pmod(F.xxhash64("uid"), F.col("tiles"))).alias("tile")
    dealt = vectors.select("uid", "columns").join(family.select("uid", "root", "n", "members", tile, met.alias("met")), "uid")
    dealt = dealt.withColumn("other", F.explode("met"))
    return dealt.groupBy("root", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")).agg(
        F.collect_list(F.struct("uid", "n", "members", "tile", "columns")).alias("rows")
    )


def join(
    docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, first_block: float | None = None
) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, n_links; ``similarity`` in percent.

    ``n_links`` is the number of other documents that a document links with, those of equal sets too.
    """
    rows, sets, vectors, roots = _linked(docs, words, similarity, first_block)
    met = _meetings(rows, sets, vectors, roots, similarity)
    counted = met.select("low", "high", "rows").mapInArrow(_link_counts(similarity), "uid long, links long")
    counted = counted.groupBy("uid").agg(F.sum("links").alias("links"))
    counted = sets.join(counted, "uid").select("cls", "links")
    sizes = rows.where("n > 0").groupBy("cls").agg((F.count("*") - 1).alias("equal"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("equal")).alias("n_links")
    named = _components(rows, sets, roots).join(sizes, "cls").join(counted, "cls", "left")
    found = _members(rows, named.select("cls", "component_id", n_links))
    return found.withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))


def links(
    docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, first_block: float | None = None
) -> DataFrame:
    """Every link between different sets: (a, b), the smallest ids of the two classes, a < b.

    Documents of equal sets are one class; a class whose members have no id at all shows as null, first.
    """
    rows, sets, vectors, roots = _linked(docs, words, similarity, first_block)
    met = _meetings(rows, sets, vectors, roots, similarity)
    found = met.select("low", "high", "rows").mapInArrow(_pairs(similarity), "a long, b long")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    first = sets.join(classes, "cls").select("uid", "first")
    one, two = first.toDF("a", "x"), first.toDF("b", "y")
    swap = F.col("y").isNull() | (F.col("y") < F.col("x"))
    low, high = F.when(swap, F.col("y")).otherwise(F.col("x")), F.when(swap, F.col("x")).otherwise(F.col("y"))
    return found.join(one, "a").join(two, "b").select(low.alias("a"), high.alias("b"))


def representatives(
    docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, first_block: float | None = None
) -> DataFrame:
    """The documents whose id is their component's, with all columns: one of each component.

    Repeated rows count once. Rows that share an id although their texts differ stand or fall together.
    """
    rows, sets, _, roots = _linked(docs, words, similarity, first_block)
    found = cut(_members(rows, _components(rows, sets, roots)), "joined")
    same_id = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stay = found.where(same_id).groupBy("doc_id").agg(F.count("*").alias("n"))
    go = join_same(found.where(~same_id).select("doc_id").distinct(), stay, ["doc_id"], "left_anti")
    go = cut(go, "go")
    kept = join_same(docs, F.broadcast(go) if go.count() <= SMALL_IDS else go, ["doc_id"], "left_anti")
    often = stay.where("n > 1").select("doc_id")
    if often.isEmpty():
        return kept
    often = cut(often, "often")
    once = join_same(kept, often, ["doc_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return join_same(kept, often, ["doc_id"], "left_anti").unionByName(once)
