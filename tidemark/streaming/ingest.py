"""Resumable ingest of staged archive listings.

Each run takes the listing files that arrived since the last one, skips domains that were
already taken, and appends snapshots and log rows. Which domains are taken is state of the
stream, kept by domain beside its progress, so a batch costs what arrived and never reads the
log of those before. Every micro-batch owns one folder and overwrites it, and state is
versioned by batch, so a batch replayed after a failure leaves the tables as if it ran once.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.snapshot_asof import cutoff_rows
from tidemark.sources.snapshots import LISTING_SCHEMA, parse_listings, query_log
from tidemark.sources.tabular import glob_paths, path_exists

LOG_SCHEMA = (
    "website_domain string, source_url string, cdx_http_status int, snapshot_rows int, error string, truncated boolean, batch long"
)
SNAPSHOT_SCHEMA = (
    "website_domain string, timestamp string, original string, statuscode string, mimetype string, digest string,"
    " snapshot_dt timestamp_ntz, batch long"
)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not glob_paths(spark, path + "/batch=*"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def taken_log(spark: SparkSession, out: str) -> DataFrame:
    """One row per domain taken so far."""
    return _table(spark, posixpath.join(out, "log"), LOG_SCHEMA)


def taken_snapshots(spark: SparkSession, out: str) -> DataFrame:
    return _table(spark, posixpath.join(out, "snapshots"), SNAPSHOT_SCHEMA)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ORDER = ["error", "digest", "cdx_http_status"]


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _first_answer(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The domain's first row in the order of ``ORDER``, unknowns last, if it is not taken.
    Chunks pass one by one, so a domain with very many answers needs the memory of one."""
    if state.exists:
        return
    best = None
    for chunk in chunks:
        both = chunk if best is None else pd.concat([best, chunk])
        best = both.sort_values(ORDER, na_position="last", kind="stable").head(1)
    state.update((True,))
    yield best


def first_answers(listings: DataFrame) -> DataFrame:
    """Of a stream of listings, the first one of each domain; of those that arrive together
    the same one in any order of arrival. Later ones are dropped. Rows without a domain
    are dropped, as there is nothing to take."""
    rows = listings.filter("website_domain is not null").withColumn("error", F.coalesce("error", F.lit("")))
    rows = rows.withColumn("digest", F.md5(F.col("payload").cast("binary")))
    kept = rows.groupBy("website_domain").applyInPandasWithState(
        _first_answer, rows.schema, "taken boolean", "append", GroupStateTimeout.NoTimeout
    )
    return kept.drop("digest")


def ingest_listings(spark: SparkSession, staged: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Process all staged files not yet seen, then stop.

    ``checkpoint`` holds progress and taken domains, spread over as many state partitions as
    the first run had shuffle partitions; ``out`` belongs to it. A log without the progress
    that wrote it is an error, as its domains would be taken again.
    """
    if not path_exists(spark, posixpath.join(checkpoint, "offsets")) and path_exists(spark, posixpath.join(out, "log")):
        raise ValueError(f"{out} holds a log, but {checkpoint} holds no progress")

    def take(fresh: DataFrame, batch_id: int) -> None:
        fresh = fresh.persist()
        for name, rows in (("snapshots", parse_listings(fresh)), ("log", query_log(fresh))):
            rows.write.mode("overwrite").parquet(posixpath.join(out, name, f"batch={batch_id}"))
        fresh.unpersist()

    stream = spark.readStream.schema(LISTING_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(staged)
    writer = (
        first_answers(stream).writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    # State on local disk, with its changes in the checkpoint: it outgrows memory.
    with _setting(spark, STATE_STORE, ON_DISK):
        query = writer.start()
    query.awaitTermination()


def rows_so_far(spark: SparkSession, out: str, cutoffs: Sequence[str], lookback_days: int = 730) -> DataFrame:
    """Cutoff rows of every domain taken so far, error rows included."""
    log = taken_log(spark, out)
    return cutoff_rows(log, taken_snapshots(spark, out), cutoffs, lookback_days, log)
