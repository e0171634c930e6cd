"""The scan over messages as they arrive: Structured Streaming over the same transformations as the batch scan.

Each micro-batch is scanned like a table and written into a folder of its own number, which a retry replaces, so a lost
executor or a restart neither loses nor repeats findings. No state is kept and nothing is too late: a message that is
delivered twice has its findings in two batches, and `read_findings` counts them once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siftbed.operators import matching
from siftbed.operators.catalog import Rule

MESSAGES = "message_id bigint, source_key string, source_tool string, source_file string, conversation_id string, ts_raw string, ingested_at timestamp, role string, seq bigint, text string"


def watched(spark: SparkSession, folder: str, schema: str = MESSAGES, files_per_batch: int = 100) -> DataFrame:
    """Messages of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_findings(messages: DataFrame, folder: str, checkpoint: str, rules: tuple[Rule, ...] | None = None, once: bool = False) -> StreamingQuery:
    """Starts the scan of a stream of messages; findings go to `folder` as Parquet by batch. `once` ends when all is read."""

    def scanned(batch: DataFrame, number: int) -> None:
        found = matching.findings(batch, rules).drop("matched_text")
        found.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = messages.writeStream.foreachBatch(scanned).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of all batches, each of a message once."""
    return spark.read.parquet(folder).drop("batch").distinct()
