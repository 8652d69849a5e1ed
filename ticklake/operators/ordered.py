"""Running values, previous rows and sliding frames over groups of any size.

A plain window pulls a whole group into one task, and a group here (an exchange, a metric
series) may hold a third of all rows. So the ordered axis is cut into chunks:

* *prefix* operators (running sum, previous row) work inside a chunk and add what one small
  row per (group, chunk) carries over from the chunks before it;
* *sliding* operators copy the rows of the last ``width`` units of a slot into the next one,
  so every frame is complete inside its slot; a frame is added up anew for each row, so they are for
  frames of few rows;
* *sliding sums* cut the axis into blocks as long as the frame, so that a frame is the end of one block and the
  start of the next: two running values, whatever the frame holds.

Prefix operators read their input twice, once for the rows and once for the totals, and write
nothing; a caller whose input costs much more than a scan may write it out first (``session.cut``).

Both cut by an expression over the row itself, which gives the same chunks on every retry.
Callers choose chunks that bound the rows in them: ``seq div n`` over a unique number holds
at most n rows; a time slot holds at most slot / resolution rows per group once the rows are
reduced to one per group and tick of the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 20


def seq_chunk(seq: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a unique arrival number: no chunk holds more than ``rows`` rows."""
    return F.call_function("div", F.col(seq), F.lit(rows))


def time_chunk(ts: str, seconds: int) -> Column:
    return F.call_function("div", F.unix_micros(F.col(ts)), F.lit(seconds * 1_000_000))


def spread_chunk(df: DataFrame, seq: str, parts: int = 1024) -> Column:
    """Chunk number of any arrival number: the span of the numbers in ``parts`` equal pieces.

    However sparse the numbers are, there are no more chunks than that.
    """
    ends = df.agg(F.min(seq).alias("lo"), F.max(seq).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    return F.floor((F.col(seq) - lo).cast("double") * parts / (hi - lo + 1)).cast("bigint")


def _place(keys: Sequence[str], chunk: Column) -> Column:
    """Group and chunk as one struct: never null itself, and null members are equal to each other."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias("chunk"))


def _chunks(keys: Sequence[str]):
    """The chunks of a group in order, as a window over one row per chunk."""
    return Window.partitionBy(*[F.col("_k")[f"k{i}"] for i in range(len(keys))]).orderBy(F.col("_k")["chunk"])


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    chunk: Column,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    maxima_before: dict[str, Column] | None = None,
    lags: dict[str, str] | None = None,
) -> DataFrame:
    """Running values and previous rows per group, in one pass over the rows.

    Adds a running total per entry of ``sums``, a running maximum per entry of ``maxima`` (of
    ``maxima_before``: over the rows before), and the value of the row before per entry of ``lags``
    (name -> column; ``order`` is then unique per group). Null keys form groups like any other.
    """
    sums, maxima, earlier, lags = sums or {}, maxima or {}, maxima_before or {}, lags or {}
    every = {**sums, **maxima, **earlier}
    src = df.select("*", _place(keys, chunk).alias("_k"), *[e.alias(f"_v_{n}") for n, e in every.items()])
    last = [F.max_by(F.struct(*[F.col(c).alias(n) for n, c in lags.items()]), order).alias("_last")] if lags else []
    totals = src.groupBy("_k").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in (*maxima, *earlier)],
        *last,
    )
    chunks = _chunks(keys)
    past = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        "_k",
        *[F.sum(f"_t_{n}").over(past).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(past).alias(f"_c_{n}") for n in (*maxima, *earlier)],
        *([F.lag("_last").over(chunks).alias("_last")] if lags else []),
    )
    # Same key as the local windows, so one shuffle of the rows serves join and windows.
    out = src.join(carry, "_k")
    rows = Window.partitionBy("_k").orderBy(order)
    until, before = (rows.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    first = F.row_number().over(rows) == 1
    zero = F.lit(0)
    return out.select(
        *df.columns,
        *[(F.coalesce(F.sum(f"_v_{n}").over(until), zero) + F.coalesce(f"_c_{n}", zero)).alias(n) for n in sums],
        *[F.greatest(F.max(f"_v_{n}").over(until), F.col(f"_c_{n}")).alias(n) for n in maxima],
        *[F.greatest(F.max(f"_v_{n}").over(before), F.col(f"_c_{n}")).alias(n) for n in earlier],
        *[F.when(first, F.col("_last")[n]).otherwise(F.lag(c).over(rows)).alias(n) for n, c in lags.items()],
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], chunk: Column) -> DataFrame:
    """Add one running total per entry of ``values`` (name -> summed expression)."""
    return prefix(df, keys, order, chunk, sums=values)


def running_max(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], chunk: Column) -> DataFrame:
    """Add one running maximum per entry; null until the first non-null value."""
    return prefix(df, keys, order, chunk, maxima=values)


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, name: str, chunk: Column) -> DataFrame:
    """Add a 1-based row number per group."""
    return running_sum(df, keys, order, {name: F.lit(1).cast("bigint")}, chunk)


def previous(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], chunk: Column) -> DataFrame:
    """Add the value of the row before, per group (name -> source column). ``order`` is unique per group."""
    return prefix(df, keys, order, chunk, lags=values)


def run_starts(
    df: DataFrame, keys: Sequence[str], ts: str, active: str, name: str, chunk: Column, max_gap_s: float | None = None
) -> DataFrame:
    """Add ``name``: where the unbroken run of ``active`` rows that a row belongs to began (null outside).

    With ``max_gap_s`` a longer time between two rows breaks a run.
    """

    def begins(was: Column, before: Column, now: Column) -> Column:
        broken = ~F.coalesce(was, F.lit(False))
        if max_gap_s is not None:
            gap = F.unix_micros(now.cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
            broken = broken | (gap > F.lit(int(max_gap_s * 1_000_000)))
        return broken

    rows = Window.partitionBy("_k").orderBy(ts)
    src = df.select("*", _place(keys, chunk).alias("_k")).select(
        "*", F.lag(active).over(rows).alias("_was"), F.lag(ts).over(rows).alias("_at"), F.row_number().over(rows).alias("_rn")
    )
    inner = F.when(F.col(active) & (F.col("_rn") > 1) & begins(F.col("_was"), F.col("_at"), F.col(ts)), F.col(ts))
    src = src.withColumn("_inner", inner)
    end = F.struct(F.col(active).alias("on"), F.col(ts).alias("at"))
    ends = src.groupBy("_k").agg(
        F.min_by(end, ts).alias("_first"), F.max_by(end, ts).alias("_end"), F.max("_inner").alias("_latest")
    )
    chunks = _chunks(keys)
    past = chunks.rowsBetween(Window.unboundedPreceding, -1)
    known = ends.withColumn("_prior", F.lag("_end").over(chunks))
    opening = F.when(
        F.col("_first.on") & begins(F.col("_prior.on"), F.col("_prior.at"), F.col("_first.at")), F.col("_first.at")
    )
    known = known.withColumn("_opening", opening)
    carry = known.select(
        "_k", "_opening", F.max(F.coalesce("_latest", "_opening")).over(past).alias("_carried")
    )
    start = F.when(F.col("_rn") == 1, F.col("_opening")).otherwise(F.col("_inner"))
    out = src.join(carry, "_k").withColumn("_start", start)
    until = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    began = F.coalesce(F.max("_start").over(until), F.col("_carried"))
    return out.select(*df.columns, F.when(F.col(active), began).alias(name))


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    width: int,
    aggregates: dict,
    slot: int | None = None,
) -> DataFrame:
    """Add aggregates over the rows with ``axis`` in (x - width, x], per group.

    ``axis`` is a whole number, unique per group; ``aggregates`` maps a name to a function
    from the frame (a WindowSpec) to a Column.
    """
    slot = slot or max(3600, 60 * width)
    if slot < width:
        raise ValueError("a slot must be at least as long as the frame")
    own = F.call_function("div", F.col(axis) - F.pmod(F.col(axis), F.lit(slot)), F.lit(slot))
    spill = (own + 1) * slot - F.col(axis) < width
    copies = F.when(spill, F.array(own, own + 1)).otherwise(F.array(own))
    src = df.select("*", F.explode(copies).alias("_slot"))
    frame = Window.partitionBy(*keys, "_slot").orderBy(axis).rangeBetween(-(width - 1), 0)
    out = src.select("*", *[make(frame).alias(n) for n, make in aggregates.items()])
    return out.where(F.col("_slot") == own).drop("_slot")


def sliding_sums(
    df: DataFrame, keys: Sequence[str], axis: str, width: int, value: str, total: str, first: str, number: str
) -> DataFrame:
    """Sum and first entry of ``value`` and number of rows over ``axis`` in (x - width, x], per group.

    The same as ``sliding`` with ``F.sum``, ``F.first`` and ``F.count("*")``, at a cost per row that does not depend on
    the rows in a frame. ``axis`` is a whole number, unique per group; rows without it are left out.

    With blocks of ``width`` a frame is what lies after x - width in the block before, and its own block up to x.
    Nothing is subtracted, so sums of decimals are exact, and a NaN is in the frames that hold it only.
    """
    block = F.call_function("div", F.col(axis) - F.pmod(F.col(axis), F.lit(width)), F.lit(width))
    names = df.columns
    until = (Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy(*keys, "_block").orderBy(axis).rangeBetween(*until)
    begun = df.where(F.col(axis).isNotNull()).select("*", block.alias("_block")).select(
        "*",
        F.sum(value).over(own).alias("_until"),
        F.first(F.struct(F.col(value).alias("v"))).over(own).alias("_opens"),
        F.count("*").over(own).alias("_rows"),
    )
    # Each row meets the block before as a question at x - width, which comes before a row of that very place.
    asks = F.array(F.lit(False), F.lit(True))
    met = begun.select("*", F.explode(asks).alias("_asks")).withColumns(
        {
            "_at": F.when(F.col("_asks"), F.col(axis) - F.lit(width)).otherwise(F.col(axis)),
            "_block": F.when(F.col("_asks"), F.col("_block") - 1).otherwise(F.col("_block")),
        }
    )
    later = Window.partitionBy(*keys, "_block").orderBy(F.col("_at").desc(), F.col("_asks").desc()).rangeBetween(*until)
    row = ~F.col("_asks")
    out = met.select(
        "*",
        F.sum(F.when(row, F.col(value))).over(later).alias("_after"),
        F.last(F.when(row, F.struct(F.col(value).alias("v"))), ignorenulls=True).over(later).alias("_starts"),
        F.count_if(row).over(later).alias("_more"),
    ).where("_asks")
    both = F.coalesce(F.col("_after") + F.col("_until"), "_after", "_until")
    return out.select(
        *names,
        both.alias(total),
        F.coalesce("_starts", "_opens")["v"].alias(first),
        (F.col("_rows") + F.col("_more")).alias(number),
    )
