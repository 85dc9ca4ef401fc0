"""Result tables, the per-cutoff tree and stage tables."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tabular import path_exists, remove_path


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables: the cluster's checkpoint folder. A session in one
    process gets a temporary folder, once; on more machines the executors would each write
    to their own disk, so a cluster without a checkpoint folder is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidemark-stages-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def stage(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame], root: str | None = None) -> DataFrame:
    """Read the stage table of this name and key, building and writing it first if absent.

    The written table cuts the lineage: a lost executor re-reads files instead of
    recomputing the stages before. ``key`` must change with the inputs and settings. A
    table counts as present only once its success mark is, so a broken write is redone.
    """
    path = posixpath.join(root or stage_root(spark), f"{name}-{key}")
    if not path_exists(spark, posixpath.join(path, "_SUCCESS")):
        rows = build()
        with shuffles_released(spark):
            rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Writes inside remove their shuffle files once they are through. Otherwise these stay
    until the driver happens to collect garbage, while the next stages write theirs."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a frame that several jobs will read and return the written table. Columnar,
    so later readers prune columns and push filters down; survives lost executors."""
    spark = df.sparkSession
    key = uuid.uuid4().hex
    _open_cuts.append(posixpath.join(stage_root(spark), f"{name}-{key}"))
    return stage(spark, name, key, lambda: df)


_open_cuts: list[str] = []


class Cuts:
    """Paths of the tables that :func:`cut` wrote inside a ``with``; ``delete`` removes them
    once nothing built on them will be read again."""

    def __enter__(self) -> Cuts:
        self._start, self.paths = len(_open_cuts), []
        return self

    def __exit__(self, *_: object) -> None:
        self.paths = _open_cuts[self._start :]
        del _open_cuts[self._start :]

    def delete(self, spark: SparkSession) -> None:
        for path in self.paths:
            remove_path(spark, path)
        self.paths = []


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """One result table as a directory of parts."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("emptyValue", "")
    writer.format(fmt).save(path)


def write_crawl_tree(rows: DataFrame, domain_map: DataFrame, root: str, fmt: str = "parquet", append: bool = False) -> None:
    """Proxy rows by cutoff, with the domain map and the domain list written once. Ranges of
    (cutoff, domain) keep each task to one or two cutoff folders of even size. ``append``
    adds the rows to those already there."""
    spread = rows.repartitionByRange("cutoff_date", "website_domain")
    write_table(spread, posixpath.join(root, "proxy"), fmt, ("cutoff_date",), "append" if append else "overwrite")
    write_table(domain_map, posixpath.join(root, "domain_company_mapping"), fmt)
    write_table(domain_map.select("website_domain").distinct(), posixpath.join(root, "domains"), fmt)
