"""Jobs as streams: items come in micro-batches, each published with the summary of all items so far. One job at a
time; the first failure ends it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..storage import shared_base


class JobBusy(RuntimeError):
    """A second job while one is active."""


class JobFailed(RuntimeError):
    """An item of the job failed; the items after it were not run."""


#: Names of jobs begin with it; other streams of the session are not the queue's.
JOB = "job:"


def _guard(spark: SparkSession, name: str) -> None:
    """One job at a time, whatever its name."""
    if any((q.name or "").startswith(JOB) for q in spark.streams.active):
        raise JobBusy(name)


def run_job(items: DataFrame, out: str, checkpoint: str, name: str = "job", failed: str = "failed", stop_on_failure: bool = True):
    """Starts the job over a streaming frame of item results. Each micro-batch appends its rows to `out` under its own
    number, so a batch that is run again after a loss replaces itself and counts once. After each batch the summary of all
    of them is written anew to `out`-summary, from a row of sums for each batch."""
    _guard(items.sparkSession, name)

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        spark, sums = batch.sparkSession, f"{out}-sums"
        spark.read.parquet(f"{out}/batch={number}").agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed")).write.mode("overwrite").parquet(f"{sums}/batch={number}")
        spark.read.parquet(sums).agg(F.sum("n").alias("n"), F.sum("n_failed").alias("n_failed"), F.max("batch").alias("batch")).write.mode("overwrite").json(f"{out}-summary")
        if stop_on_failure and batch.where(failed).limit(1).count():
            raise JobFailed(name)

    return items.writeStream.queryName(JOB + name).foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(spark: SparkSession, out: str) -> DataFrame:
    """What a job has published so far, with the number of its batch."""
    return spark.read.parquet(out)


def performance(query) -> dict:
    """What a finished job took, from the stream's own progress: batches, rows, seconds (rounded half to even)."""
    done = [p for p in query.recentProgress if p["numInputRows"]]
    return {"batches": len(done), "rows": sum(p["numInputRows"] for p in done), "seconds": round(sum(p["durationMs"].get("triggerExecution", 0) for p in done) / 1000, 3)}


def summaries(rows: DataFrame, failed: str = "failed") -> DataFrame:
    """batch, n, n_failed: the running summary after each batch, from sums of each (a window over batches, not items)."""
    from pyspark.sql import Window as W

    sums = rows.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"), F.sum("n_words").cast("long").alias("n_words"))
    w = W.orderBy("batch").rowsBetween(W.unboundedPreceding, W.currentRow)
    return sums.select("batch", *[F.sum(c).over(w).alias(c) for c in ("n", "n_failed", "n_words")])


def prefixes(rows: DataFrame, order: str, group: list[str]) -> DataFrame:
    """The summary after each item of a group, in order, of what has been published, however it came in batches."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select(*group, order, F.count("*").over(w).alias("n"), F.sum(F.col("failed").cast("int")).over(w).alias("n_failed"), F.sum("n_words").over(w).cast("long").alias("n_words"))


def stream_documents(spark: SparkSession, sf_dir: str, max_chars: int = 6000) -> DataFrame:
    """lang, cohort, doc_id, n, n_failed, n_words: the documents as a stream of items, published in micro-batches, and the
    summary after each item of its cohort."""
    folder = f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    items = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    rows = items.select("doc_id", "lang", (F.col("doc_id") % 16).alias("cohort"), word_count("text").alias("n_words"), (F.length("text") > max_chars).alias("failed"))
    run_job(rows, f"{folder}/out", f"{folder}/checkpoint", name=f"documents-{uuid.uuid4().hex}", stop_on_failure=False).awaitTermination()
    return prefixes(published(spark, f"{folder}/out"), "doc_id", ["lang", "cohort"])
