"""Analytics over metric samples and pipeline counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklake.functions import fill_percent, label_map
from ticklake.operators import ordered

# Metrics of the runtime rather than of the pipeline.
RUNTIME_METRICS = "^process_runtime|^target_info"


def estimated_drops(counters: DataFrame) -> DataFrame:
    """Backlog (incoming - received) and estimated drops (what is neither received nor queued)."""
    lost = F.col("incoming") - F.col("received") - F.col("queued")
    return counters.select(
        "*",
        (F.col("incoming") - F.col("received")).alias("backlog"),
        F.greatest(lost, F.lit(0)).alias("dropped"),
    )


def drop_warnings(counters: DataFrame, threshold: int = 100) -> DataFrame:
    return estimated_drops(counters).where(F.col("dropped") > threshold)


def fill_levels(fills: DataFrame) -> DataFrame:
    """Latest fill per channel and, with a null channel, over all channels."""
    latest = fills.groupBy("channel").agg(
        F.max_by("count", "ts").alias("count"), F.max_by("capacity", "ts").alias("capacity")
    )
    return (
        latest.rollup("channel")
        .agg(F.sum("count").alias("count"), F.sum("capacity").alias("capacity"))
        .withColumn("fill_pct", fill_percent(F.col("count"), F.col("capacity")))
    )


def gauge_totals(samples: DataFrame, by: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """Sum of a gauge over its label sets, and whether it is drained.

    Without a sample the state is unknown (null), not drained.
    """
    return (
        samples.groupBy(*by)
        .agg(F.sum(value).alias("total"), F.count(value).alias("samples"))
        .withColumn("drained", F.when(F.col("samples") > 0, F.col("total") <= 0))
    )


def drain_time(totals: DataFrame) -> DataFrame:
    """First time the total is back to 0 after its peak (one row; null when it never was)."""
    peak = totals.agg(F.max_by(F.col("ts"), F.struct("total", -F.unix_micros("ts")))).scalar()
    return totals.agg(
        F.min(F.when((F.col("ts") >= peak) & (F.col("total") <= 0), F.col("ts"))).alias("drained_at"),
        F.max("total").alias("peak"),
    )


def channel_shares(batches: DataFrame, slot: str = "channel", amount: str = "batch_size") -> DataFrame:
    """Load per channel, its share in percent, and the ratio to an even split."""
    per = batches.groupBy(slot).agg(F.sum(amount).alias("total"))
    # One row per channel, so the window over all of them is small.
    every = Window.partitionBy()
    whole, n = F.sum("total").over(every), F.count("*").over(every)
    return per.select(
        slot,
        "total",
        F.try_divide(F.col("total") * F.lit(100.0), whole).alias("pct"),
        F.try_divide(F.col("total") * F.lit(1.0) * n, whole).alias("imbalance"),
    )


def catalog(samples: DataFrame) -> DataFrame:
    """Distinct metrics with sample counts and first / last sample time, sorted."""
    return (
        samples.groupBy("metric")
        .agg(
            F.count("*").alias("rows"),
            F.min("ts").alias("first_sample"),
            F.max("ts").alias("last_sample"),
        )
        .orderBy("metric")
    )


def sample_times(samples: DataFrame) -> DataFrame:
    """Number of distinct sample times, first and last of them."""
    times = samples.select("ts").distinct()
    return times.agg(
        F.count("*").alias("samples"), F.min("ts").alias("first_sample"), F.max("ts").alias("last_sample")
    )


def select_metrics(
    samples: DataFrame, exclude: str | None = None, metric: str | None = None, label: str | None = None
) -> DataFrame:
    """Filter by name pattern to leave out, by exact name and by label pattern."""
    if exclude is not None:
        samples = samples.where(~F.col("metric").rlike(exclude))
    if metric is not None:
        samples = samples.where(F.col("metric") == metric)
    if label is not None:
        samples = samples.where(F.col("labels").rlike(label))
    return samples


def first_and_last(samples: DataFrame) -> DataFrame:
    """Samples of the first and of the last sample time of a run."""
    ends = samples.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    return samples.where((F.col("ts") == lo) | (F.col("ts") == hi))


def last_sample_listing(samples: DataFrame, exclude: str = RUNTIME_METRICS) -> DataFrame:
    """Pipeline metrics at the last sample time, sorted by metric and labels."""
    last = samples.agg(F.max("ts")).scalar()
    return select_metrics(samples.where(F.col("ts") == last), exclude).orderBy("metric", "labels")


def run_deltas(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """First and last value per series, their difference and growth per second."""
    return (
        samples.groupBy(*keys)
        .agg(
            F.min_by(value, "ts").alias("first_value"),
            F.max_by(value, "ts").alias("last_value"),
            ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1_000_000.0)).alias("seconds"),
        )
        .withColumn("delta", F.col("last_value") - F.col("first_value"))
        .withColumn("per_second", F.try_divide(F.col("delta").cast("double"), F.col("seconds")))
    )


def compare_metrics(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics of two runs side by side, with ratio and a change flag."""
    a = base.select(*keys, F.col("value").alias("base"))
    b = other.select(*keys, F.col("value").alias("other"))
    return (
        a.join(b, list(keys))
        .withColumn(
            "ratio",
            F.when(F.col("base") > 0, F.try_divide(F.col("other").cast("double"), F.col("base"))).otherwise(
                F.lit(0.0)
            ),
        )
        .withColumn(
            "change",
            F.when(F.col("other") > F.col("base"), "up")
            .when(F.col("other") < F.col("base"), "down")
            .otherwise("same"),
        )
    )


# --- histograms ---------------------------------------------------------------------------


def observe(
    df: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float], total: str | None = None
) -> DataFrame:
    """Histogram of a column: rows (labels, le, cumulative, count, sum), ``+Inf`` as infinity.

    A null value is no observation.

    ``total`` names a decimal column to sum instead, for a sum that does not depend on order.

    Rows are counted per label set and bucket first. The running count then sees at most
    one row per bucket and the bounds are joined in as an array, so nothing is multiplied
    before it is reduced.
    """
    edges = [float(b) for b in bounds] + [float("inf")]
    place = F.lit(len(edges) - 1)
    for i in reversed(range(len(bounds))):
        place = F.when(F.col(value) <= edges[i], F.lit(i)).otherwise(place)
    slots = df.where(F.col(value).isNotNull()).groupBy(*labels, place.alias("_i")).agg(
        F.count("*").alias("_n"), F.sum(total or value).alias("_s")
    )
    per_label = slots.groupBy(*labels).agg(
        F.map_from_entries(F.collect_list(F.struct("_i", "_n"))).alias("_m"),
        F.sum("_n").alias("count"),
        F.sum("_s").alias("sum"),
    )
    cumulative = F.transform(
        F.sequence(F.lit(0), F.lit(len(edges) - 1)),
        lambda i: F.struct(
            F.element_at(F.array(*[F.lit(e) for e in edges]), i + 1).alias("le"),
            F.aggregate(
                F.sequence(F.lit(0), i),
                F.lit(0).cast("bigint"),
                lambda a, j: a + F.coalesce(F.try_element_at("_m", j), F.lit(0).cast("bigint")),
            ).alias("cumulative"),
        ),
    )
    return per_label.select(*labels, F.explode(cumulative).alias("_b"), "count", "sum").select(
        *labels, "_b.le", "_b.cumulative", "count", "sum"
    )


def histogram_means(buckets: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Mean per label set: sum / count."""
    top = buckets.where(F.col("le") == F.lit(float("inf")))
    return top.select(
        *labels, "count", "sum", F.try_divide(F.col("sum").cast("double"), F.col("count")).alias("mean")
    )


def histogram_quantile(buckets: DataFrame, labels: Sequence[str], q: float) -> DataFrame:
    """Quantile read off the buckets, linear inside a bucket; the last bound for the open one."""
    by = Window.partitionBy(*labels).orderBy("le")
    steps = buckets.select(
        *labels,
        "le",
        "cumulative",
        F.coalesce(F.lag("le").over(by), F.lit(0.0)).alias("_lo"),
        F.coalesce(F.lag("cumulative").over(by), F.lit(0)).alias("_below"),
        (F.lit(float(q)) * F.col("count")).alias("_rank"),
    )
    # The lowest quantile is the lower end of the first bucket that holds anything.
    lowest = (F.col("_rank") == 0) & (F.col("_below") == 0) & (F.col("cumulative") > 0)
    hit = steps.where(((F.col("cumulative") >= F.col("_rank")) & (F.col("_below") < F.col("_rank"))) | lowest)
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * (F.col("_rank") - F.col("_below")) / (
        F.col("cumulative") - F.col("_below")
    )
    return hit.select(
        *labels, F.when(F.col("le") == F.lit(float("inf")), F.col("_lo")).otherwise(inside).alias("quantile")
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Discrete quantiles per group: the smallest value that at least that part of the rows reaches.

    Rows are counted per value, and the quantiles read off the running count, so a hot group is one
    row per task and value; groups of very many different values are worked through in chunks of
    their value's range.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    running = ordered.running_sum(counts, keys, value, {"_until": F.col("_n")}, ordered.spread_chunk(counts, value))
    place = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.lit(1)
    whole = counts.groupBy(*keys).agg(F.sum("_n").alias("_all")).select(place.alias("_k"), "_all")
    joined = running.withColumn("_k", place).join(whole, "_k")
    reached = {n: F.min(F.when(F.col("_until") >= F.ceil(F.col("_all") * F.lit(q)), F.col(value))) for n, q in wanted.items()}
    return joined.groupBy(*keys).agg(*[e.alias(n) for n, e in reached.items()])


def insert_efficiency(batches: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Inserted per received, and write time of the slowest batch."""
    return batches.groupBy(*labels).agg(
        F.count("*").alias("batches"),
        F.sum("batch_size").alias("received"),
        F.sum("inserted").alias("inserted"),
        F.try_divide(F.sum("inserted").cast("double"), F.sum("batch_size").cast("double")).alias("efficiency"),
        F.max("duration_ms").alias("max_ms"),
    )


# --- alerts -------------------------------------------------------------------------------

# Alert rules as (name, severity, metric, comparison, threshold, minutes held), and the
# label that the samples must carry, if any.
ALERT_RULES = [
    ("MarketDataChannelBacklogHigh", "warning", "processor_channel_backlog", ">", 50000, 2),
    ("MarketDataChannelBacklogCritical", "critical", "processor_channel_backlog", ">", 100000, 2),
    ("MarketDataTicksDropped", "warning", "rate:ticks_dropped_silently_total", ">", 1000, 2),
    ("MarketDataAllWebSocketsDown", "critical", "ws_active_connections", "==", 0, 3),
    ("MarketDataWebSocketsDegraded", "warning", "ws_active_connections", "<", 3, 5),
    ("MarketDataExceptionsSpike", "warning", "rate:exceptions_total", ">", 10, 5),
    ("MarketDataWorkerUnhealthy", "critical", "probe_success", "==", 0, 2, ("job", "blackbox-health")),
]


def counter_rate(
    samples: DataFrame, keys: Sequence[str], window_s: int = 300, value: str = "value"
) -> DataFrame:
    """Growth per second of a counter over the trailing window, at each sample.

    Takes one sample per series and instant (``rates.one_per_instant`` makes it so).
    Growth is summed between the samples inside the window and divided by the whole window, also
    where the series is younger; a counter that falls was reset and grew by its new value. Null
    where the window holds a single sample.
    """
    slot_s = max(3600, window_s)
    stepped = ordered.previous(samples, keys, "ts", {"_prev": value}, ordered.time_chunk("ts", slot_s))
    grown = stepped.withColumn(
        "_grow",
        F.when(F.col("_prev").isNull(), F.lit(0)).when(F.col(value) < F.col("_prev"), F.col(value)).otherwise(
            F.col(value) - F.col("_prev")
        ),
    ).withColumn("_ms", F.unix_millis("ts"))
    framed = ordered.sliding_sums(grown, keys, "_ms", window_s * 1000, "_grow", "_sum", "_first", "_n")
    rate = (F.col("_sum") - F.col("_first")).cast("double") / F.lit(float(window_s))
    return framed.select(*samples.columns, F.when(F.col("_n") > 1, rate).alias("rate"))


def held_for(
    samples: DataFrame,
    keys: Sequence[str],
    condition: Column,
    seconds: int,
    slot_s: int = 3600,
    max_gap_s: float | None = None,
) -> DataFrame:
    """Mark the samples at which the condition has held without a break for ``seconds``.

    Takes one sample per series and instant (``rates.one_per_instant`` makes it so).
    ``since`` is the first sample of the unbroken run; ``firing`` is true once it is old enough. With
    ``max_gap_s`` a run does not reach across a longer time without samples.
    """
    chunk = ordered.time_chunk("ts", slot_s)
    state = samples.withColumn("active", F.coalesce(condition, F.lit(False)))
    run = ordered.run_starts(state, keys, "ts", "active", "since", chunk, max_gap_s)
    old = (F.unix_micros("ts") - F.unix_micros("since")) >= F.lit(seconds * 1_000_000)
    return run.withColumn("firing", F.coalesce(F.col("active") & old, F.lit(False)))


def breaches(value: Column, comparison: str, threshold: float) -> Column:
    """Whether a value breaks a limit; NaN breaks none."""
    limit = F.lit(threshold)
    hit = {">": value > limit, "<": value < limit, "==": value == limit}[comparison]
    return hit & ~F.isnan(value.cast("double"))


def carries(samples: DataFrame, label: tuple[str, str] | None) -> Column:
    """Whether samples carry a label, given as a column of its name or inside ``labels`` text."""
    if label is None:
        return F.lit(True)
    name, value = label
    if name in samples.columns:
        return F.coalesce(F.col(name) == value, F.lit(False))
    if "labels" in samples.columns:
        return F.coalesce(F.try_element_at(label_map(F.col("labels")), F.lit(name)) == value, F.lit(False))
    return F.lit(False)


def evaluate_rules(
    samples: DataFrame, keys: Sequence[str], rules=ALERT_RULES, window_s: int = 300, max_gap_s: float | None = None
) -> DataFrame:
    """All alert rules over samples (metric, keys, ts, value): one row per sample and rule that fires.

    Rules share one pass: each sample is matched with the rules of its metric, then the
    unbroken runs are followed per (rule, series). A rule with a label looks only at samples that
    carry it: in a column of the label's name, or in a ``labels`` column. Samples with neither column
    never meet such a rule.
    """
    rules = [(*r, None)[:7] for r in rules]
    chosen = {label for *_, label in rules if label}
    marks = {label: f"_has_{i}" for i, label in enumerate(sorted(chosen))}
    samples = samples.select("*", *[carries(samples, label).alias(c) for label, c in marks.items()])
    kinds = {r[2] for r in rules}
    plain = samples.where(F.col("metric").isin([m for m in kinds if not m.startswith("rate:")]))
    counters = samples.where(F.col("metric").isin([m[5:] for m in kinds if m.startswith("rate:")]))
    held = [*keys, *marks.values()]
    rated = counter_rate(counters, ["metric", *keys], window_s).select(
        F.concat(F.lit("rate:"), "metric").alias("metric"), *held, "ts", F.col("rate").alias("value")
    )
    readings = plain.select("metric", *held, "ts", F.col("value").cast("double").alias("value")).unionByName(rated)

    matched = F.lit(None)
    entry = "struct<alertname:string,severity:string,hold_s:int,hit:boolean>"
    for metric in sorted(kinds):
        mine = [
            F.when(
                F.col(marks[label]) if label else F.lit(True),
                F.struct(F.lit(n), F.lit(s), F.lit(m * 60), breaches(F.col("value"), op, t)).cast(entry),
            )
            for n, s, k, op, t, m, label in rules
            if k == metric
        ]
        matched = F.when(F.col("metric") == metric, F.array(*mine)).otherwise(matched)
    per_rule = readings.select("metric", *keys, "ts", "value", F.explode(matched).alias("r")).select(
        "metric", *keys, "ts", "value", "r.*"
    ).where("alertname is not null")
    followed = held_for(per_rule, ["alertname", *keys], F.col("hit"), 0, max_gap_s=max_gap_s)
    age = F.unix_micros("ts") - F.unix_micros("since")
    return followed.where(F.col("active") & (age >= F.col("hold_s") * 1_000_000)).select(
        "alertname", "severity", *keys, "ts", "value", "since"
    )


def alert_groups(firing: DataFrame) -> DataFrame:
    """Firing samples grouped the way notifications are: by alert name and severity."""
    return firing.groupBy("alertname", "severity").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")
    )


# --- health -------------------------------------------------------------------------------


def health(components: DataFrame, clients: DataFrame) -> DataFrame:
    """One row: overall status from component rows (name, status) and client rows (connected).

    Components that are healthy, disabled, unknown or without a status do not degrade; all
    clients down does, no client at all is unknown.
    """
    ws = clients.agg(
        F.count("*").alias("total"), F.count_if(F.col("connected")).alias("connected")
    ).select(
        "total",
        "connected",
        F.when(F.col("total") == 0, "unknown")
        .when(F.col("connected") > 0, "healthy")
        .otherwise("unhealthy")
        .alias("websocket"),
    )
    fine = F.coalesce(F.col("status").isin("healthy", "disabled", "unknown"), F.lit(True))
    # An empty component list degrades nothing.
    parts_fine = components.agg(F.coalesce(F.bool_and(fine), F.lit(True))).scalar()
    degraded = ~parts_fine | ((F.col("total") > 0) & (F.col("connected") == 0))
    return ws.select(
        F.when(degraded, "degraded").otherwise("healthy").alias("status"),
        "websocket",
        "total",
        "connected",
        (F.col("total") - F.col("connected")).alias("disconnected"),
    )


def client_summary(clients: DataFrame) -> DataFrame:
    """Summed rate and connected / disconnected counts over client rows."""
    return clients.agg(
        F.sum("rate").alias("incoming_rate"),
        F.count_if(F.col("connected")).alias("connected"),
        F.count_if(~F.col("connected")).alias("disconnected"),
    )


def client_rows(counts: DataFrame, log: DataFrame, at: int, seconds: int = 10) -> DataFrame:
    """One row per client (exchange, symbol): connected, rate at a given second, total messages.

    ``counts`` holds messages per (exchange, ticker, sec); the rate is the sliding mean that
    ends at second ``at``.
    """
    recent = (F.col("sec") > at - seconds) & (F.col("sec") <= at)
    state = log.groupBy("exchange").agg(F.max_by("status", "seq").alias("status"))
    per_client = counts.groupBy("exchange", F.col("ticker").alias("symbol")).agg(
        F.coalesce(F.avg(F.when(recent, F.col("n"))), F.lit(0.0)).alias("rate"),
        F.sum("n").alias("messages"),
    )
    return per_client.join(state, "exchange", "left").select(
        "exchange",
        F.concat_ws("_", "exchange", "symbol").alias("name"),
        "symbol",
        (F.coalesce("status", F.lit("Disconnected")) == "Connected").alias("connected"),
        "rate",
        "messages",
    )
