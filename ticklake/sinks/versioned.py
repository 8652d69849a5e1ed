"""The tick table with versions: inserts by several writers, edits merged on read, folded in by maintenance.

An insert of absent ticks compares with the version it saw; if another writer was first, only what that one added
is compared again. Setting columns of some rows, or deleting them, writes the edits alone: per day a
small file of keys with the changed columns. A reader joins the edits of a day to its rows, last one first; days
without edits are read as they are. ``fold`` rewrites days with edits or many files into one set of files.

An edit changes the rows that were there before it: a row has the version of the commit that brought it, an
edit that of its own, and edits of lower versions leave a row alone. So a key may be deleted and inserted
again. Folded rows keep the version their fold read, so edits that came meanwhile still reach them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ticklake import files, versions
from ticklake.functions import required
from ticklake.operators.dedup import first_arrival
from ticklake.operators.joins import extent, missing_keys
from ticklake.schemas import RAW_TICK, TICK_KEY
from ticklake.sinks.ticks import laid_out, to_rows
from ticklake.versions import EDITS, ROWS, Entry, Version

#: Columns that an edit may set; the others are what a row is found by.
EDITABLE = ["trade_id", "price", "volume", "normalized"]
#: Bloom filters of the id in folded files. Small commits have none: there the time of receipt tells files apart.
BLOOM = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
#: An edit file: the key, whether the row goes, and for each column whether it is set and to what.
EDIT = StructType(
    [
        *[RAW_TICK[c] for c in TICK_KEY],
        StructField("gone", BooleanType()),
        *[StructField(f"set_{c}", BooleanType()) for c in EDITABLE],
        *[RAW_TICK[c] for c in EDITABLE],
        RAW_TICK["dt"],
    ]
)


def _names(days: Iterable[date | str] | None) -> list[str] | None:
    return None if days is None else [d if isinstance(d, str) else d.isoformat() for d in days]


def _numbered(spark: SparkSession, rows: DataFrame, entries: list[Entry]) -> DataFrame:
    """Rows with the version of their commit and day in ``_v``."""
    known = spark.createDataFrame([(e.commit, e.day, e.version) for e in entries], "commit string, _day string, _v long")
    # As many rows as the table has folders, which the driver holds anyway.
    marked = rows.withColumn("_day", F.col("dt").cast("string"))
    return marked.join(F.broadcast(known), ["commit", "_day"]).drop("commit", "_day")


def read(spark: SparkSession, path: str, version: Version | None = None, days: Iterable[date | str] | None = None) -> DataFrame:
    """The table as of a version (the newest), all of it or some days, with its edits applied."""
    version = versions.latest(spark, path) if version is None else version
    days = _names(days)
    rows, edits = version.of(ROWS, days), version.of(EDITS, days)
    edited = {e.day for e in edits}
    plain = [e for e in rows if e.day not in edited]
    out = versions.frame(spark, path, plain, RAW_TICK).select(*RAW_TICK.names)
    touched = [e for e in rows if e.day in edited]
    if not touched:
        return out
    held = _numbered(spark, versions.frame(spark, path, touched, RAW_TICK), touched)
    merged = _merged(held, _last_edits(spark, path, edits))
    return merged.unionByName(out) if plain else merged


def _last_edits(spark: SparkSession, path: str, entries: list[Entry]) -> DataFrame:
    """Per key the version of its last delete and, for each column, the last value and its version.

    Plain aggregates of one pass, so a key that is edited over and over is one row per task.
    """
    edits = _numbered(spark, versions.frame(spark, path, entries, EDIT), entries)
    last = [F.max(F.when(F.col("gone"), F.col("_v"))).alias("_gone")]
    for c in EDITABLE:
        when = F.when(F.col(f"set_{c}"), F.col("_v"))
        last += [F.max(when).alias(f"_at_{c}"), F.max_by(c, when).alias(f"_to_{c}")]
    return edits.groupBy("dt", *TICK_KEY).agg(*last)


def _merged(rows: DataFrame, edits: DataFrame) -> DataFrame:
    joined = rows.join(edits, ["dt", *TICK_KEY], "left")
    alive = joined.where(F.coalesce(F.col("_gone") < F.col("_v"), F.lit(True)))
    newest = [
        F.when(F.col(f"_at_{c}") > F.col("_v"), F.col(f"_to_{c}")).otherwise(F.col(c)).alias(c) if c in EDITABLE else F.col(c)
        for c in RAW_TICK.names
    ]
    return alive.select(*newest)


def find(spark: SparkSession, path: str, keys: DataFrame, version: Version | None = None) -> DataFrame:
    """The rows with some keys (ticker, exchange, ts): only files, row groups and pages that can hold one are read."""
    version = versions.latest(spark, path) if version is None else version
    keys = keys.select(*TICK_KEY).distinct()
    part = extent(keys)
    days = [d for d in version.days(ROWS) if part.low is not None and str(part.low.date()) <= d <= str(part.high.date())]
    return part.of(read(spark, path, version, days)).join(keys, TICK_KEY, "left_semi").select(*RAW_TICK.names)


def _entries(commit: str, days: Iterable[str], kind: str, version: int) -> list[Entry]:
    return [Entry(commit, d, kind, version) for d in days]


def adopt(spark: SparkSession, flat: DataFrame, path: str) -> Version | None:
    """Make an unpartitioned table (columns of the tick table, with or without ``dt``) the first version of one by day.

    Its rows are written aside and appear with one commit: readers see the old table until then and the new one
    from then on, and no moment without a table. None if the path has versions already, however often it is called.
    """
    if versions.latest(spark, path).number:
        return None
    rows = flat.withColumn("dt", F.to_date("ts")).select(*RAW_TICK.names)
    commit, days = versions.write(laid_out(rows), path, BLOOM)
    try:
        return versions.commit(spark, path, Version(), _entries(commit, days, ROWS, 1))
    except versions.Conflict:
        return None


def append(spark: SparkSession, rows: DataFrame, path: str) -> Version:
    """Add rows of the table without looking for conflicts."""
    commit, days = versions.write(laid_out(rows), path)
    return versions.retried(
        spark, path, lambda base: versions.commit(spark, path, base, _entries(commit, days, ROWS, base.number + 1))
    )


def insert_new(
    spark: SparkSession,
    ticks: DataFrame,
    path: str,
    received_at: Column | None = None,
    mark: tuple[str, int] | None = None,
    drop: Sequence[Entry] = (),
    between=lambda: None,
) -> DataFrame:
    """Insert the ticks whose key is new; return the rows that were inserted, read from their files.

    Any number of writers may do so at once: the one whose commit comes second drops the keys that
    the other brought. With ``mark`` (stream, batch) a batch that is in the table already returns the rows
    it brought then. ``drop`` are entries that the same commit takes out. ``between`` runs after each write, before
    its commit.
    """
    base = versions.latest(spark, path)
    if mark and base.written(*mark):
        return _brought(spark, path, base, mark)
    whole = ticks.where(required(*TICK_KEY))
    batch = to_rows(first_arrival(whole), received_at)
    if base.of(ROWS):
        part = extent(whole)
        held = [d for d in base.days(ROWS) if part.low is not None and str(part.low.date()) <= d <= str(part.high.date())]
        if held:
            batch = missing_keys(batch, part.of(read(spark, path, base, held)))
    commit, days = versions.write(laid_out(batch), path)
    while True:
        between()
        made = _entries(commit, days, ROWS, base.number + 1)
        if not made and not mark and not drop:
            return versions.frame(spark, path, [], RAW_TICK).select(*RAW_TICK.names)
        try:
            versions.commit(spark, path, base, made, drop, (*mark, commit) if mark else None)
            return versions.frame(spark, path, made, RAW_TICK).select(*RAW_TICK.names)
        except versions.Conflict:
            now = versions.latest(spark, path)
            if mark and now.written(*mark):
                return _brought(spark, path, now, mark)
            seen, base = set(base.entries), now
            others = [e for e in now.of(ROWS, days) if e not in seen]
            if others:
                mine = versions.frame(spark, path, made, RAW_TICK).select(*RAW_TICK.names)
                brought = versions.frame(spark, path, others, RAW_TICK)
                commit, days = versions.write(laid_out(missing_keys(mine, brought)), path)


def _brought(spark: SparkSession, path: str, version: Version, mark: tuple[str, int]) -> DataFrame:
    """The rows that a batch brought, as it wrote them; only the last batch of a stream can be asked for."""
    number, commit = version.marks[mark[0]]
    if number != mark[1]:
        raise ValueError(f"batch {mark[1]} of stream {mark[0]} was followed by batch {number}")
    days = files.partition_folders(spark, f"{path.rstrip('/')}/commit={commit}")
    return versions.frame(spark, path, _entries(commit, days, ROWS, 0), RAW_TICK).select(*RAW_TICK.names)


def _write_edits(spark: SparkSession, edits: DataFrame, path: str) -> Version:
    commit, days = versions.write(edits.select(*EDIT.names).hint("rebalance", F.col("dt")), path)
    return versions.retried(
        spark, path, lambda base: versions.commit(spark, path, base, _entries(commit, days, EDITS, base.number + 1))
    )


def _edits(keys: DataFrame, gone: bool, columns: Sequence[str]) -> DataFrame:
    set_ = [F.lit(c in columns).alias(f"set_{c}") for c in EDITABLE]
    values = [(F.col(c) if c in columns else F.lit(None)).cast(RAW_TICK[c].dataType).alias(c) for c in EDITABLE]
    return keys.select(*TICK_KEY, F.lit(gone).alias("gone"), *set_, *values, F.to_date("ts").alias("dt"))


def delete_rows(spark: SparkSession, path: str, keys: DataFrame) -> Version:
    """Remove the rows with these keys that are in the table now; writes the keys alone."""
    return _write_edits(spark, _edits(keys.where(required(*TICK_KEY)).select(*TICK_KEY).distinct(), True, []), path)


def update_rows(spark: SparkSession, path: str, edits: DataFrame, columns: Sequence[str]) -> Version:
    """Set ``columns`` of the rows with the keys in ``edits``; writes the edits alone.

    Two edits of one key are an error, as neither is the right one. Keys that the table does not hold change nothing.
    """
    unknown = set(columns) - set(EDITABLE)
    if unknown:
        raise ValueError(f"cannot set {sorted(unknown)}")
    edits = edits.where(required(*TICK_KEY))
    if not edits.groupBy(*TICK_KEY).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("two edits of one key")
    return _write_edits(spark, _edits(edits, False, columns), path)


def mark_normalized(spark: SparkSession, path: str, keys: DataFrame) -> Version:
    return update_rows(spark, path, keys.select(*TICK_KEY).distinct().withColumn("normalized", F.lit(True)), ["normalized"])


def fold(spark: SparkSession, path: str, most_files: int = 8, between=lambda: None) -> Version | None:
    """Rewrite the days that have edits or more than ``most_files`` commits into one; None if there are none.

    Commits of others in the meantime stay: their rows are not among the folded ones, their edits have a
    higher version. If another fold was first, this one starts anew.
    """
    while True:
        base = versions.latest(spark, path)
        count: dict[str, int] = {}
        for e in base.of(ROWS):
            count[e.day] = count.get(e.day, 0) + 1
        days = sorted(base.days(EDITS) | {d for d, n in count.items() if n > most_files})
        if not days:
            return None
        commit, kept = versions.write(laid_out(read(spark, path, base, days)), path, BLOOM)
        old = [*base.of(ROWS, days), *base.of(EDITS, days)]
        between()
        made = versions.replaced(spark, path, base, _entries(commit, kept, ROWS, base.number), old)
        if made:
            return made
