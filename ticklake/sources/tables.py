"""Reading the stored tables and run results."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DateType, StructField, StructType

from ticklake import files
from ticklake.schemas import CANDLE, CONNECTION_LOG, RAW_TICK, RUN_RESULT


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_TICK).parquet(path)


#: The candle table as it is stored, by day.
CANDLE_TABLE = StructType(CANDLE.fields + [StructField("dt", DateType(), True)])


def read_days(spark: SparkSession, path: str, days: Iterable[date], schema: StructType = RAW_TICK) -> DataFrame:
    """A table (by default of ticks) restricted to some days, without listing the files of the others.

    A batch that touches one day of a table of thousands should not list them all.
    """
    folders = files.partition_folders(spark, path)
    wanted = [folders[d.isoformat()] for d in sorted(days) if d.isoformat() in folders]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*wanted)


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDLE_TABLE).parquet(path)


def read_connection_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONNECTION_LOG).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run results: one JSON object per line, or a JSON array per file."""
    return spark.read.schema(RUN_RESULT).json(path)


def read_runs_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_RESULT).json(path, multiLine=True)


def write_runs(runs: DataFrame, path: str) -> None:
    runs.select(*[f.name for f in RUN_RESULT.fields]).write.json(path)
