"""Metric samples from scraped text, and metric CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.functions import label_map, metric_value, normalise_value_text, with_once
from ticklake.operators import ordered
from ticklake.operators.joins import lookup
from ticklake.schemas import METRIC_CSV

# A sample line of the text format: a name, labels in braces (quoted values may hold braces and escaped
# quotes), a value and, perhaps, a time in milliseconds.
_LABELS = r'\{((?:[^"{}]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)\}'
_VALUE = r"[+\-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+\-]?[0-9]+)?|NaN|[iI]nf)"
_SAMPLE = rf"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\s*{_LABELS})?\s+({_VALUE})(?:\s+-?[0-9]+)?\s*$"
_HISTOGRAM_SUFFIX = "_(bucket|sum|count)$"
# A character that no metric text contains, to carry the three parts of one match.
_MARK = "\x01"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, a file over as many tasks as it has splits.

    ``line_no`` is the start of the line's split plus the line's number in it: it grows along the file and occurs once,
    as a split starts behind all bytes, and so behind all lines, of those before it.
    """
    split = spark.read.text(path, lineSep="\n").select(
        F.input_file_name().alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    first = split.groupBy("file", "_start").agg(F.min("_row").alias("_first"))
    return split.join(first, ["file", "_start"]).select("file", (F.col("_start") + F.col("_row") - F.col("_first")).alias("line_no"), "line")


def read_scrapes(spark: SparkSession, path: str) -> DataFrame:
    """Scrape files as (scrape, line_no, line); one file is one scrape, read by as many tasks as it has splits."""
    return _lines(spark, path).withColumnRenamed("file", "scrape")


def _directives(lines: DataFrame) -> DataFrame:
    """Lines that start with # as kind help, type or comment, with metric name and text."""
    only = lines.where(F.trim("line").startswith("#"))
    split = with_once(only, "_p", F.split(F.trim("line"), " +", 4))
    word, size = F.upper(F.try_element_at("_p", F.lit(2))), F.size("_p")
    kind = F.when((size >= 3) & (word == "HELP"), "help").when((size >= 3) & (word == "TYPE"), "type")
    rows = split.select(*lines.columns, F.coalesce(kind, F.lit("comment")).alias("kind"), "_p")
    told = F.col("kind") != "comment"
    return rows.select(
        *lines.columns,
        "kind",
        F.when(told, F.col("_p")[2]).alias("metric"),
        F.when(told, F.coalesce(F.try_element_at("_p", F.lit(4)), F.lit(""))).alias("about"),
    )


def _samples(lines: DataFrame) -> DataFrame:
    """All other lines as kind sample, blank or dead; one regex pass per line."""
    text = F.trim("line")
    marked = F.regexp_replace(text, _SAMPLE, f"$1{_MARK}$2{_MARK}$3")
    rows = with_once(lines.where(~text.startswith("#")), "_p", F.split(marked, _MARK))
    hit = F.size("_p") == 3
    return rows.select(
        *lines.columns,
        F.when(hit, "sample").when(F.col("_p")[0] == "", "blank").otherwise("dead").alias("kind"),
        F.when(hit, F.col("_p")[0]).alias("metric"),
        F.when(hit, F.col("_p")[1]).alias("labels"),
        F.when(hit, normalise_value_text(F.col("_p")[2])).alias("value"),
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """All lines with their kind: help, type, comment, sample, blank or dead (not readable)."""
    return _directives(lines).unionByName(_samples(lines), allowMissingColumns=True)


def samples(lines: DataFrame, scrape: str = "scrape", strict_name: bool = False) -> DataFrame:
    """Samples with the type and help text that their scrape gives for the metric.

    The last directive of a name wins. ``_bucket``, ``_sum`` and ``_count`` rows take the text
    of their histogram unless ``strict_name`` asks for the full name only.
    """
    found = _samples(lines).where(F.col("kind") == "sample").drop("kind")
    stem = F.regexp_replace("metric", _HISTOGRAM_SUFFIX, "").alias("_stem")
    kinds = {
        name: F.max_by(F.when(F.col("kind") == k, F.col("about")), F.when(F.col("kind") == k, F.col("line_no")))
        for name, k in (("type", "type"), ("description", "help"))
    }
    about = (
        _directives(lines)
        .where(F.col("kind") != "comment")
        .groupBy(scrape, "metric")
        .agg(*[e.alias(n) for n, e in kinds.items()])
        # At most four names share a stem: itself and the three suffixes.
        .groupBy(scrape, stem)
        .agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("type", "description")))).alias("_about"))
    )
    joined = lookup(found.withColumn("_stem", stem), about, [scrape, "_stem"], "left")
    own = F.try_element_at("_about", F.col("metric"))
    family = F.try_element_at("_about", F.col("_stem"))
    out = joined.select(*found.columns, own.alias("_own"), family.alias("_family"))

    def told(name: str) -> Column:
        texts = [F.col("_own")[name]] + ([] if strict_name else [F.col("_family")[name]])
        return F.coalesce(*texts, F.lit("")).alias(name)

    return out.select(*found.columns, told("type"), told("description"))


def typed(rows: DataFrame) -> DataFrame:
    """Text samples as typed ones: labels as a map, value as double."""
    return rows.withColumn("labels", label_map(F.col("labels"))).withColumn(
        "value", metric_value(F.col("value"))
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metric CSV files (header, UTF-8, quotes doubled); all columns stay text.

    A file is read by as many tasks as it has splits, also where quoted fields hold line breaks: a line begins a
    record if the quotes before it are even, which running counts over pieces of the file tell. The lines of one record
    meet, never those of a file. A quote that is never closed makes the rest of its file one record.
    """
    lines = _lines(spark, path).withColumn("_quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))
    chunk = ordered.seq_chunk("line_no")
    counted = ordered.running_sum(lines, ["file"], "line_no", {"_upto": F.col("_quotes")}, chunk)
    opens = (F.col("_upto") - F.col("_quotes")) % 2 == 0
    # A record is named by its first line: the last line before or at this one that begins a record.
    named = ordered.running_max(
        counted.select("file", "line_no", "line", F.when(opens, F.col("line_no")).alias("_first")),
        ["file"], "line_no", {"_record": F.col("_first")}, chunk,
    )
    whole = named.groupBy("file", "_record").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_lines"))
    header = whole.groupBy("file").agg(F.min("_record").alias("_header"))
    records = whole.join(header, "file").where(F.col("_record") > F.col("_header"))
    text = records.select(F.array_join("_lines.line", "\n").alias("text")).where(F.trim("text") != "")
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    return text.select(F.from_csv("text", METRIC_CSV.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r")).select("r.*")


def write_csv(rows: DataFrame, path: str) -> None:
    """Samples as CSV, every field quoted and quotes doubled."""
    rows.select(
        *[F.col(f.name) for f in METRIC_CSV.fields]
    ).write.option("header", True).option("quoteAll", True).option("quote", '"').option(
        "escape", '"'
    ).option("emptyValue", "").csv(path)
