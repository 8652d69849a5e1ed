"""Exact duplicates through an extendible-hash index on shared files.

1. *Entries.* Every document's text is normalised (each run of ASCII white space becomes one space,
   null is empty) and hashed to 64 bits; (doc_id, key, digest) goes to a file in the shared folder.
2. *Directory.* Keys with their counts (combined on the map side, so copies are one row per task)
   are counted by the leading bits of the key. Starting from one bucket, the directory doubles as
   long as a bucket holds more keys than a page: an overfull bucket splits in two by one more bit,
   the others stay shared. A bucket ends up as (depth, prefix); a directory too shallow for a full
   bucket gets further bits.
3. *Owners.* A bucket's place in the directory is its prefix at full depth; the index lies in that order. Keys with
   a single entry are decided by it.
4. *Chains.* Texts whose key occurs more than once are read again. Each task first combines its own equal texts,
   then what is left goes to the owners: by a range partitioning of (place, key, digest), so that one task owns a
   range of buckets, and a key with very many different texts is spread over owners by digest. An owner
   sorts its entries by key, digest and text and runs along them: equal bytes become one link of the key's chain,
   with the smallest doc_id and the number of documents. No further exchange follows: the owners' runs are the result.
5. *Answers.* Entries take the answer of their key, or of their key's link with their digest.

DataFrame functions only. A group with a third of all rows leaves each task of step 2 and 4 as one row, and is
met again only by an equi-join on its key, which adaptive execution splits.

Edge cases: null and empty texts are equal to each other (not to a single space); a null doc_id
never is the one kept unless its whole group has none; repeated rows are copies, also with the same
doc_id, of which exactly one is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.llm.common import SPACE, join_same
from ticklake.session import cut

#: Keys a bucket may hold before it splits, and the bits a directory grows by when it is too shallow.
PAGE_KEYS, STEP_BITS = 10_000, 4
MAX_BITS = 48
#: Ids of copies up to which they are sent to all tasks (8 bytes each).
SMALL_IDS = 500_000
#: Pairs of id and digest up to which the copies that go are sent to all tasks (some 100 bytes each).
SMALL_PAIRS = 50_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def hash64(text: Column) -> Column:
    return F.xxhash64(text)


def prefix(key: Column, bits: Column | int) -> Column:
    """The leading bits of a 64-bit key as a number; 0 for no bits."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    moved = F.call_function("shiftrightunsigned", key, (F.lit(64) - bits).cast("int"))
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(moved)


def directory(keys: DataFrame, page_keys: int = PAGE_KEYS) -> tuple[DataFrame, int]:
    """Buckets (cell, depth, bucket) of the keys, and the directory's depth in bits.

    ``cell`` runs over the occupied entries of the directory (leading bits of the key at full
    depth); ``bucket`` is the prefix that the entry's bucket is shared by. Depth follows the number
    of keys: cells are counted, then a bucket is the shortest prefix that holds a page or less.
    """
    bits = 0
    while True:
        bits = min(bits + STEP_BITS, MAX_BITS)
        cells = cut(keys.groupBy(prefix(F.col("key"), bits).alias("cell")).agg(F.count("*").alias("n")), "cells")
        # Driver sees one number: whether some entry is still over a page at this depth.
        if bits == MAX_BITS or cells.where(F.col("n") > page_keys).isEmpty():
            break
    depths = F.sequence(F.lit(0), F.lit(bits))
    shared = cells.select("cell", "n", F.explode(depths).alias("depth")).withColumn(
        "prefix", F.call_function("shiftright", F.col("cell"), F.lit(bits) - F.col("depth"))
    )
    full = shared.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    fits = shared.join(full, ["depth", "prefix"]).where((F.col("held") <= page_keys) | (F.col("depth") == bits))
    lowest = fits.groupBy("cell").agg(F.min(F.struct("depth", "prefix")).alias("b"))
    return lowest.select("cell", F.col("b.depth").alias("depth"), F.col("b.prefix").alias("bucket")), bits


def _chains(texts: DataFrame, several: DataFrame) -> DataFrame:
    """Texts (doc_id, text, key) of repeated keys -> key, text_sha256, keep_id, group_size: a row per link of a chain."""
    here = texts.withColumn("task", F.spark_partition_id())
    own = here.groupBy("key", "text", "task").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    dealt = own.withColumn("text_sha256", F.sha2("text", 256)).join(several, "key")
    owned = dealt.repartitionByRange("place", "key", "text_sha256")
    # Range partitions of (place, key, digest) hold whole groups of those and the text: the owners aggregate in place.
    links = owned.groupBy("place", "key", "text_sha256", "text").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    return cut(links.select("key", "text_sha256", "keep_id", "group_size"), "chains")


def duplicates(docs: DataFrame, page_keys: int = PAGE_KEYS, key: Callable[[Column], Column] = hash64) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256; one row per document."""
    text = normalised(F.col("text"))
    entry = docs.select("doc_id", text.alias("_text")).select(
        "doc_id", key(F.col("_text")).alias("key"), F.sha2("_text", 256).alias("text_sha256")
    )
    entries = cut(entry.withColumn("row", F.monotonically_increasing_id()), "entries")
    keys = cut(entries.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "keys")
    cells, bits = directory(keys, page_keys)

    # The index: keys in the order of their buckets' places in the directory.
    place = F.call_function("shiftleft", F.col("bucket"), (F.lit(bits) - F.col("depth")).cast("int"))
    placed = keys.withColumn("cell", prefix(F.col("key"), bits)).join(cells, "cell").select("key", "n", "first", place.alias("place"))
    index = cut(placed.repartitionByRange("place", "key").sortWithinPartitions("place", "key"), "index")

    single = index.where("n = 1").select("key", F.col("first").alias("keep_id"), F.col("n").alias("group_size"))
    several = index.where("n > 1").select("key", "place")
    wanted = cut(entries.join(several, "key").select("doc_id").distinct(), "wanted")

    # Texts of repeated keys only: their ids go to all tasks while they are few, else the texts are shuffled to them.
    few = wanted.count() <= SMALL_IDS
    again = join_same(docs.select("doc_id", "text"), F.broadcast(wanted) if few else wanted, ["doc_id"], "left_semi")
    texts = again.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("key", key(F.col("text")))
    found = entries.join(single, "key").unionByName(
        entries.join(_chains(texts, several), ["key", "text_sha256"]), allowMissingColumns=True
    )
    # Among rows that share the kept id (repeated rows) exactly one stays. A row number occurs once,
    # so this join has no hot key.
    same_id = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    first = found.where(same_id).groupBy("key", "text_sha256").agg(F.min("row").alias("row"))
    marked = found.join(first.select("row", F.lit(True).alias("_kept")), "row", "left")
    kept = F.coalesce(F.col("_kept"), F.lit(False)).alias("kept")
    return marked.select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def unique(docs: DataFrame, page_keys: int = PAGE_KEYS) -> DataFrame:
    """The documents that stay, with all their columns: one of each group of equal texts."""
    pair = ["doc_id", "_sha"]
    found = cut(duplicates(docs, page_keys).select("doc_id", "kept", F.col("text_sha256").alias("_sha")), "found")
    # Repeated rows share id and text, so a pair may both stay and go: it is kept once.
    pairs = found.groupBy(*pair).agg(F.max(F.col("kept").cast("int")).alias("stays"), F.count("*").alias("n"))
    go = cut(pairs.where("stays = 0").select(*pair), "go")
    often = cut(pairs.where("stays = 1 and n > 1").select(*pair), "often")
    marked = docs.withColumn("_sha", F.sha2(normalised(F.col("text")), 256))
    kept = join_same(marked, F.broadcast(go) if go.count() <= SMALL_PAIRS else go, pair, "left_anti")
    if not often.isEmpty():
        repeated = join_same(kept, often, pair, "left_semi").dropDuplicates(pair)
        kept = join_same(kept, often, pair, "left_anti").unionByName(repeated)
    return kept.drop("_sha")
