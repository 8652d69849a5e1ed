"""The ingest stream: messages in, ticks, candles and dead letters out."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ticklake.operators.candles import ohlcv
from ticklake.schemas import RAW_TICK, TICK
from ticklake.session import adaptive
from ticklake import files
from ticklake.sinks import candle_tiers, versioned
from ticklake.sinks.candles import NO_STREAM, Sink, append_batch, write_batch
from ticklake.sinks.ticks import append, insert_ignore, new_rows
from ticklake.sources.candle_topic import decode
from ticklake.sources.messages import dead_letters, parse, ticks


def message_stream(
    spark: SparkSession,
    path: str,
    schema: str = "seq BIGINT, value STRING",
    files_per_trigger: int | None = None,
    bytes_per_trigger: int | None = None,
    form: str = "parquet",
) -> DataFrame:
    """Messages from a folder of files; the rate limit is what sizes a batch.

    ``bytes_per_trigger`` follows the size of the messages where files differ in size; the topic
    source limits by rows (``candle_topic.subscribe``).
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.format(form).load(path)


#: Parts into which a partition of messages is split at most, while the cluster has cores without one.
SPREAD = 8


def spread(messages: DataFrame) -> DataFrame:
    """Messages on as many tasks as there are cores, if they come in fewer partitions.

    Parsing is the dearest step of a batch, and a file of one row group, or one partition of a topic, is one task
    however large it is. Moving the raw messages costs little beside that.
    """
    parts, cores = messages.rdd.getNumPartitions(), messages.sparkSession.sparkContext.defaultParallelism
    return messages.repartition(min(cores, SPREAD * parts)) if 0 < parts < cores else messages


def trigger(seconds: int | None) -> dict:
    """Batches every so many seconds, or everything there is and then stop."""
    return {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}


class Ingest:
    """One stream, three tables: ticks (insert-if-absent), partial candles, dead letters.

    Every output of a batch is idempotent: the tick insert skips keys that are there, the other
    two overwrite a folder per stream and batch. The new ticks of a batch are staged once, so that a
    replay after a failure half-way sees the same rows although the table has them by then.

    Several feeds may share a base, one after the other or each with its own job: stage, candles
    and dead letters lie by stream, whose id is that of its checkpoint. A new checkpoint is a new
    stream; it reads its source anew, and the insert skips the ticks that are there.

    With ``keep_versions`` the ticks go to a table with versions (``sinks.versioned``) and the candles to tiers
    (``sinks.candle_tiers``): a batch is one commit, known by its mark, so nothing is staged, other writers may insert
    at the same time, and only what can hold a key of the batch is compared.
    """

    def __init__(
        self,
        exchange: str,
        base: str,
        interval_s: int = 60,
        candles_from: str = "deduped",
        seq: str | None = "seq",
        strict: bool = False,
        candle_sink: Sink | None = None,
        keep_versions: bool = False,
    ):
        if candles_from not in ("deduped", "raw"):
            raise ValueError("candles_from must be 'deduped' or 'raw'")
        self.exchange, self.base, self.interval_s = exchange, base.rstrip("/"), interval_s
        self.candles_from, self.seq, self.strict = candles_from, seq, strict
        self.tick_path, self.candle_path = f"{self.base}/ticks", f"{self.base}/candles"
        self.dead_path, self.staging = f"{self.base}/dead", f"{self.base}/staging"
        self.keep_versions, self.custom_sink = keep_versions, candle_sink is not None
        add = candle_tiers.add if keep_versions else write_batch
        self.candle_sink = candle_sink or (lambda df, n, stream: add(df, n, self.candle_path, stream))

    def batch(self, messages: DataFrame, batch_id: int, stream: str = NO_STREAM) -> None:
        with adaptive(messages.sparkSession):
            parsed = parse(spread(messages), self.exchange, strict=self.strict).persist(StorageLevel.DISK_ONLY)
            try:
                self._write(parsed, batch_id, stream)
            finally:
                parsed.unpersist()

    def _write(self, parsed: DataFrame, batch_id: int, stream: str) -> None:
        spark = parsed.sparkSession
        dead = f"{self.dead_path}/stream={stream}/batch_id={batch_id}"
        dead_letters(parsed).write.mode("overwrite").parquet(dead)
        found = ticks(parsed, self.seq)
        if self.keep_versions:
            inserted = versioned.insert_new(spark, found, self.tick_path, mark=(stream, batch_id))
            if self.candles_from == "deduped" and not inserted.inputFiles():
                return  # nothing new, so no candle changes
            source = inserted if self.candles_from == "deduped" else found
            self.candle_sink(ohlcv(source, self.interval_s), batch_id, stream)
            if not self.custom_sink:
                candle_tiers.compact(spark, self.candle_path)
            return
        own = f"{self.staging}/stream={stream}"
        stage, incoming = f"{own}/batch_id={batch_id}", f"{own}/incoming"
        replay = files.exists(spark, f"{stage}/_SUCCESS")
        if not replay:
            new_rows(spark, found, self.tick_path, incoming).write.mode("overwrite").parquet(stage)
            files.delete(spark, incoming)
        staged = spark.read.schema(RAW_TICK).parquet(stage)
        if replay:
            # Some of these rows may have reached the table before the failure.
            insert_ignore(spark, staged.select(*TICK.names), self.tick_path)
        else:
            append(staged, self.tick_path)
        source = staged if self.candles_from == "deduped" else found
        self.candle_sink(ohlcv(source, self.interval_s), batch_id, stream)
        # The batch before this one is committed by now; its stage is no longer needed.
        files.delete(spark, f"{own}/batch_id={batch_id - 1}")

    def start(self, messages: DataFrame, checkpoint: str, every_s: int | None = None) -> StreamingQuery:
        def run(batch: DataFrame, batch_id: int) -> None:
            self.batch(batch, batch_id, files.stream_id(batch.sparkSession, checkpoint))

        return (
            messages.writeStream.foreachBatch(run)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger(every_s))
            .start()
        )


def decode_candle_stream(messages: DataFrame, path: str, dead: str, checkpoint: str, every_s=None) -> StreamingQuery:
    """Consume candle messages into the candle table, then commit; a replayed batch adds nothing."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        stream = files.stream_id(batch.sparkSession, checkpoint)
        good, bad = decode(batch)
        with adaptive(batch.sparkSession):
            append_batch(good, batch_id, path, stream)
        bad.select("value").write.mode("overwrite").parquet(f"{dead}/stream={stream}/batch_id={batch_id}")

    return (
        messages.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(every_s))
        .start()
    )
