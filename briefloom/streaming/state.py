"""Memory between runs as streams.  Each query ends when what is there has been read (availableNow);
leave the trigger out for one that goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tables import staged
from ..functions.urls import canonical_url
from ..operators import history


def url_first_seen(stream: DataFrame, at: str = "recorded_at", url: str = "url") -> DataFrame:
    """The first row of each page within 30 days; older rows than the watermark are late and left out."""
    keyed = stream.withColumn("canonical_url", canonical_url(F.col(url)))
    return keyed.withWatermark(at, "30 days").dropDuplicatesWithinWatermark(["canonical_url"])


def event_first_seen(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, by: str, width: str, delay: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))


def run_available(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


#: What is written after the ledger, in this order, of what was sent.
History = dict[str, Callable[[DataFrame], DataFrame]]


def deliver_batches(spark: SparkSession, folder: str, send: Callable[[DataFrame], None], histories: History | None = None) -> Callable[[DataFrame, int], None]:
    """Sends what (day, target) has not had, then writes the ledger, and only after it the histories, each only where it has rows.

    histories: for each name what to write of the rows that were sent, such as their URLs and the snapshots of their events (history.snapshots).  All
    is written under the batch's number: one that runs again after a crash replaces its own rows.  What is in the ledger is not sent again; a
    batch that was sent but not written down is, since only the ledger tells."""
    histories = histories or {"sent": lambda due: due.select("target", "sent_at")}

    def write(batch: DataFrame, number: int) -> None:
        kind = "day date, target string, sent_at timestamp, run_status string"
        ledger = spark.read.schema(kind).option("recursiveFileLookup", True).parquet(f"{folder}/ledger") if number else spark.createDataFrame([], kind)
        if number:
            ledger = ledger.where(F.regexp_extract(F.input_file_name(), r"batch-(\d+)", 1).cast("int") < number)
        attempts = batch.withColumn("day", history.local_day(F.col("sent_at")))
        due = history.undelivered(attempts.dropDuplicates(["day", "target"]), ledger).select("day", "target")
        due = staged(attempts.join(due.hint("merge"), ["day", "target"]), "due")
        send(due)
        due.select("day", "target", "sent_at", "run_status").dropDuplicates(["day", "target"]).write.mode("overwrite").parquet(f"{folder}/ledger/batch-{number:08d}")
        for name, of in histories.items():
            rows = of(due)
            if not rows.isEmpty():
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch-{number:08d}")

    return write


def delivered_once(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/ledger")
