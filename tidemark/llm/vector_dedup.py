"""Near-duplicate vectors by sorted projection passes.

Each pass gives every vector a key of concatenated random-projection bits and sorts the
vectors of a label by it; a vector is compared with a bounded window of its successors.
Pairs at or above the threshold are verified in double precision and joined over all passes.
Windows connect a group but do not hold all of its pairs, so the links inside every connected
group are then counted exactly, block against block, without listing pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.graph import components

THRESHOLD = 0.93
WINDOW = 32
KEY_BITS = 62
MISSED = 0.01
SEED = 29
ROWS_PER_BLOCK = 2_000


def _unit(values, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f8").reshape(-1, dims)


def _valid(rows: DataFrame) -> DataFrame:
    """``uid, vec_id, label, dims, unit`` of every row; ``unit`` is the vector scaled to
    length 1 in double precision, null where it can be compared with nothing."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, n = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            dims, unit = [], []
            for vector, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                array = None
                if label is not None and vector.is_valid and vector.values.null_count == 0:
                    array = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    peak = np.abs(array).max(initial=0.0)
                    array = array / peak if 0 < peak < math.inf else None
                dims.append(0 if array is None else len(array))
                unit.append(None if array is None else (array / np.sqrt((array * array).sum()) + 0.0).astype("<f8").tobytes())
            uid = pa.array(range(first + n, first + n + batch.num_rows), pa.int64())
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([uid, batch.column(0), batch.column(2), pa.array(dims, pa.int32()), pa.array(unit, pa.binary())], names=["uid", "vec_id", "label", "dims", "unit"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "embedding", "label").mapInArrow(scale, f"uid long, vec_id long, label {kind}, dims int, unit binary")


def passes_for(largest: int, threshold: float = THRESHOLD, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes after which a pair at the threshold has been neighbours at least once but for a
    share ``missed``. A pass separates a pair on each bit with the angle's probability; a
    window of a group of n rows tells apart about log2(n / window) bits."""
    agree = 1 - math.acos(threshold) / math.pi
    together = agree ** max(1.0, math.log2(max(2, largest / window)))
    return max(4, math.ceil(math.log(missed) / math.log(1 - min(together, 0.99))))


def _keyed(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    """A row per vector and pass with the sort key of that pass."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(KEY_BITS, dtype=np.int64))[::-1]
        for batch in batches:
            all_dims = batch.column(2).to_numpy()
            for dims in np.unique(all_dims).tolist():
                if dims not in planes:
                    planes[dims] = np.random.default_rng([seed, dims]).standard_normal((dims, passes * KEY_BITS))
                some = batch.filter(pa.array(all_dims == dims))
                bits = (_unit(some.column(3).to_pylist(), dims) @ planes[dims] > 0).reshape(-1, passes, KEY_BITS)
                keys = bits @ weights
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(some.num_rows, pa.int32()).fill_null(p), some.column(0), some.column(1), some.column(2), pa.array(keys[:, p]), some.column(3)],
                        names=["pass_", "uid", "label", "dims", "key", "unit"],
                    )

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("uid", "label", "dims", "unit").mapInArrow(key, f"pass_ int, uid long, label {kind}, dims int, key long, unit binary")


def _near(uid: np.ndarray, unit: np.ndarray, group: np.ndarray, window: int, threshold: float, least_step: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at or above the threshold among rows up to ``window`` places apart."""
    a, b = [], []
    for step in range(1, min(window, len(uid) - 1) + 1):
        close = (group[step:] == group[:-step]) & (np.einsum("ij,ij->i", unit[step:], unit[:-step]) >= threshold)
        if least_step is not None:
            close &= least_step[step:] != least_step[:-step]
        a.append(uid[:-step][close])
        b.append(uid[step:][close])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _window_links(keyed: DataFrame, window: int, threshold: float) -> DataFrame:
    """Links between window neighbours. Rows are range-partitioned in sort order, so even a key
    that most rows share is spread; the rows at the ends of a partition are handed on, to be
    compared with the next partition's."""
    kind = keyed.schema["label"].dataType.simpleString()
    schema = f"a long, b long, part int, side int, place int, pass_ int, label {kind}, dims int, unit binary"
    names = ["a", "b", "part", "side", "place", "pass_", "label", "dims", "unit"]

    def group_of(table: pa.Table) -> np.ndarray:
        parts = [table.column(c).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) for c in ("pass_", "label", "dims")]
        return (parts[0] * (parts[1].max() + 1) + parts[1]) * (parts[2].max() + 1) + parts[2]

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        label_type = None
        tail, first_rows, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            label_type = batch.schema.field("label").type
            table = pa.Table.from_batches([batch])
            joined = table if tail is None else pa.concat_tables([tail, table])
            fresh = np.arange(joined.num_rows) >= (0 if tail is None else tail.num_rows)
            group, dims = group_of(joined), joined.column("dims").to_numpy()
            uid, units = joined.column("uid").to_numpy(), joined.column("unit").to_pylist()
            for d in np.unique(dims).tolist():
                here = np.flatnonzero(dims == d)
                unit = _unit([units[i] for i in here], d)
                a, b = [], []
                for step in range(1, min(window, len(here) - 1) + 1):
                    close = fresh[here][step:] & (group[here][step:] == group[here][:-step])
                    close &= np.einsum("ij,ij->i", unit[step:], unit[:-step]) >= threshold
                    a.append(uid[here][:-step][close])
                    b.append(uid[here][step:][close])
                if a:
                    yield _rows(np.concatenate(a), np.concatenate(b), label_type, names)
            if first_rows is None or first_rows.num_rows < window:
                first_rows = table.slice(0, window) if first_rows is None else pa.concat_tables([first_rows, table]).slice(0, window)
            tail = joined.slice(max(0, joined.num_rows - window))
            n += batch.num_rows
        for boundary, side, rows in ((part, 1, first_rows), (part + 1, 0, tail)):
            if rows is not None:
                k = rows.num_rows
                fixed = [pa.array([value] * k, pa.int32()) for value in (boundary, side)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("uid").combine_chunks(), pa.nulls(k, pa.int64()), *fixed, pa.array(range(k), pa.int32()), *(rows.column(c).combine_chunks() for c in ("pass_", "label", "dims", "unit"))],
                    names=names,
                )

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("place", "ascending")])
        group, dims, side = group_of(table), table.column("dims").to_numpy(), table.column("side").to_numpy()
        uid, units, found = table.column("a").to_numpy(), table.column("unit").to_pylist(), [[], []]
        for d in np.unique(dims).tolist():
            here = np.flatnonzero(dims == d)
            pairs = _near(uid[here], _unit([units[i] for i in here], d), group[here], window, threshold, side[here])
            for out, x in zip(found, pairs, strict=True):
                out += x.tolist()
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    order = ["pass_", "label", "dims", "key", "uid"]
    found = cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(slide, schema), "windows")
    ends = found.filter("b is null").groupBy("part").applyInArrow(lambda table: across(table), "a long, b long")
    return found.filter("b is not null").select("a", "b").unionByName(ends)


def _rows(a: np.ndarray, b: np.ndarray, label_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), label_type, pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), kind) for kind in kinds)], names=names)


def _counts(members: DataFrame, threshold: float) -> DataFrame:
    """``uid, n`` of other vectors linked directly, from ``uid, component, copies, unit, dims``.
    A group is dealt into blocks of bounded size; a vector goes to the products of its block."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    own = F.col("own")
    ways = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), (own > j).cast("int").alias("side")),
    )
    sent = dealt.select("component", "uid", "copies", "dims", "unit", F.inline(ways))

    def count(table: pa.Table) -> pa.Table:
        uid, copies, side = (table.column(c).to_numpy() for c in ("uid", "copies", "side"))
        unit = _unit(table.column("unit").to_pylist(), table.column("dims")[0].as_py())
        near = unit @ unit.T >= threshold
        np.fill_diagonal(near, False)
        if side.any():
            near &= side[:, None] != side[None, :]
        return pa.table({"uid": pa.array(uid), "n": pa.array(near @ copies, pa.int64())})

    return sent.groupBy("component", "i", "j").applyInArrow(lambda table: count(table), "uid long, n long").groupBy("uid").agg(F.sum("n").alias("n"))


def near_duplicate_vectors(rows: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row.

    Only vectors of equal, non-null label and equal length are compared. Null vectors, and
    those that are zero or hold null or non-finite components, link with nothing. Copies are
    one vector while comparing and count one by one. Repeated rows stay; a null id counts in
    no minimum and is never ``kept``; an empty table gives no rows.
    """
    vectors = cut(_valid(rows), "vectors")
    texts = vectors.filter("unit is not null").groupBy("label", "dims", "unit").agg(
        F.min("uid").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id")
    )
    distinct = cut(texts, "distinct_vectors")
    one = distinct.withColumnRenamed("rep", "uid")
    largest = one.groupBy("label", "dims").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    links = _window_links(_keyed(one, passes_for(largest, threshold, window), seed), window, threshold)
    groups = cut(components(links).select(F.col("node").alias("uid"), "component"), "vector_groups")
    members = one.join(groups, "uid")
    direct = _counts(members.select("uid", "component", "copies", "dims", "unit"), threshold)
    labelled = one.select("uid", "copies", "least_id").join(groups, "uid", "left").join(direct, "uid", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "uid")).withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    results = labelled.join(least, "component").select(F.col("uid").alias("rep"), "n_links", "component_id")
    # Rows find their distinct vector by value.
    by_value = distinct.join(results, "rep").select("label", "dims", "unit", "n_links", "component_id")
    out = vectors.join(by_value, ["label", "dims", "unit"], "left")
    component = F.when(F.col("unit").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
