"""Runs on command messages: a stream of texts, of which ``/merge`` starts a run, once per message."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COMMAND = "/merge"
log = logging.getLogger(__name__)


def commands(messages: DataFrame) -> DataFrame:
    """The messages whose trimmed ``value`` is the command."""
    return messages.filter(F.trim(F.col("value").cast("string")) == COMMAND)


def kafka_messages(spark: SparkSession, servers: str, topic: str = "etl-commands") -> DataFrame:
    """Messages of a topic from the latest on. Needs Spark's Kafka package; the offsets are kept in the checkpoint."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").load()


def file_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files that appear in a folder."""
    return spark.readStream.text(folder)


class Finished:
    """The positions of a batch's finished commands: an empty file each in the checkpoint. Those of earlier batches, which are never repeated, are removed."""

    def __init__(self, spark: SparkSession, checkpoint: str, batch: int):
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/finished/{name}")
        folder = self._path(batch).getParent()
        self._fs, self._batch = folder.getFileSystem(spark._jsc.hadoopConfiguration()), batch
        self._fs.mkdirs(folder)
        for status in self._fs.listStatus(folder):
            if int(status.getPath().getName().split("-")[0]) < batch:
                self._fs.delete(status.getPath(), False)

    def __contains__(self, k: int) -> bool:
        return self._fs.exists(self._path(f"{self._batch}-{k}"))

    def add(self, k: int) -> None:
        self._fs.create(self._path(f"{self._batch}-{k}"), True).close()


def run_on_commands(
    messages: DataFrame, run: Callable[[SparkSession], str], publish: Callable[[str], None], checkpoint: str, every: str = "10 seconds", once: bool = False
) -> StreamingQuery:
    """Calls ``run`` once per command and publishes its result; a failure to publish is only logged, one to run ends the query, which may be started again.

    The offset of every message is kept, commands or not, and the checkpoint remembers each finished command by its batch and its position
    there (the messages of a batch stay the same, and commands do not differ), so a batch that is repeated after a failure goes on behind
    them. Only a run that was broken off, or whose end could not be noted, is repeated.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = Finished(df.sparkSession, checkpoint, number)
        for k in range(commands(df).count()):
            if k in done:
                continue
            path = run(df.sparkSession)
            done.add(k)
            try:
                publish(f"✅ Готово: {path}")
            except Exception:
                log.warning("result of batch %s, command %s was not published", number, k, exc_info=True)

    writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def kafka_publisher(spark: SparkSession, servers: str, topic: str = "etl-results") -> Callable[[str], None]:
    """A ``publish`` for ``run_on_commands`` that writes each result as one message of a topic. Needs Spark's Kafka package."""

    def publish(text: str) -> None:
        message = spark.createDataFrame([(text,)], "value string")
        message.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return publish


def kept_running(start: Callable[[], StreamingQuery], wait: float = 5.0, longest: float = 300.0, attempts: int | None = None) -> int:
    """Starts a stream again whenever it fails, such as while a broker is away, after a pause that doubles up to ``longest`` seconds.

    Gives the number of restarts when a query ends by itself. After ``attempts`` failures behind each other, each without a finished batch, the
    last one is raised. The checkpoint makes a restart go on where the query broke off.
    """
    restarts, failures = 0, 0
    while True:
        query = None
        try:
            query = start()
            query.awaitTermination()
            return restarts
        except Exception:
            progressed = query is not None and query.lastProgress is not None
            failures = 1 if progressed else failures + 1
            if attempts is not None and failures >= attempts:
                raise
            log.warning("the stream broke off; it is started again", exc_info=True)
            time.sleep(min(longest, wait * 2 ** (failures - 1)))
            restarts += 1


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums of events per type and time window; what comes later than ``late`` is dropped. Works on streams and tables."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = e.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))
