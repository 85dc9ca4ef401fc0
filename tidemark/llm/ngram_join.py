"""N-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row per distinct n-gram set and a column per n-gram. Columns are dealt into
blocks by hash. A pass over the column blocks finds the n-grams that more than one text
holds; only those can add to an overlap, so a row whose shared n-grams fall short of its own
size bound leaves the product. The rows left are dealt into row blocks of bounded size and
each product of two row blocks accumulates its overlap counts in one array, discards the
pairs below the bound that their sizes set, and hands on a spanning forest of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, portions
from tidemark.llm.graph import components

WORDS = 5
PERCENT = 75

WORDS_PER_BATCH = 1_000_000
DOCS_PER_BATCH = 60_000
ENTRIES_PER_BLOCK = 2_000_000
ENTRIES_HELD = 10_000_000
LOW_BITS = 40
MEASURE_BLOCKS = 4096
ROWS_PER_BLOCK = 1_000
GRAMS_PER_BLOCK = 600_000
DENSE = 48
REMEMBERED = 400_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def rolling_grams(text: str | None, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """Hashes of the text's n-grams in order; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    count = len(words) - size + 1
    value = np.full(count, size, np.uint64)
    for i in range(size):
        value = (value ^ (value >> np.uint64(29))) * _MIX + each[i : i + count]
    value = (value ^ (value >> np.uint64(32))) * _END
    return value ^ (value >> np.uint64(29))


def gram_hashes(text: str | None, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams."""
    return np.unique(rolling_grams(text, hashes, width))


def _dealt(docs: DataFrame, bits: int, width: int) -> DataFrame:
    """Column blocks: n-grams of a batch of documents per block, and a row of measures per
    document (blocks below 0). Copies inside a batch send their n-grams once."""
    schema = "block int, batch long, grams binary, places binary, doc_id long, size int, digest long, text_hash long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        hashes = WordHashes()
        base = TaskContext.get().partitionId() << 40
        number = 0
        held: list[np.ndarray] = []
        places: list[int] = []
        seen: set[int] = set()
        measures: list[tuple] = []
        words = 0

        def flush() -> Iterator[pa.RecordBatch]:
            batch = base | number << 16
            ids = [m[0] for m in measures]
            yield _batch([-1 - (TaskContext.get().partitionId() + 31 * number) % MEASURE_BLOCKS] * len(ids), [batch | i for i in range(len(ids))], None, None, ids, [m[1] for m in measures], [m[2] for m in measures], [m[3] for m in measures])
            if not held:
                return
            grams = np.concatenate(held)
            owner = np.repeat(np.array(places, np.uint16), [len(h) for h in held])
            block = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
            order = np.argsort(block, kind="stable")
            grams, owner, block = grams[order], owner[order], block[order]
            low = (grams >> np.uint64(64 - bits - LOW_BITS)) & np.uint64((1 << LOW_BITS) - 1)
            low = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW_BITS // 8]
            ends = np.searchsorted(block, np.arange((1 << bits) + 1))
            rows = [(b, s, e) for b, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if e > s]
            for i in range(0, len(rows), 512):
                some = rows[i : i + 512]
                yield _batch(
                    [b for b, _, _ in some], [batch] * len(some), [low[s:e].tobytes() for _, s, e in some],
                    [_planes(owner[s:e]) for _, s, e in some], None, None, None, None,
                )

        for arrived in portions(batches):
            for doc_id, text, text_hash in zip(*(arrived.column(i).to_pylist() for i in range(3)), strict=True):
                grams = gram_hashes(text, hashes, width)
                digest = xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None
                if digest is not None and digest not in seen:
                    seen.add(digest)
                    held.append(grams)
                    places.append(len(measures))
                measures.append((doc_id, len(grams), digest, text_hash))
                words += len(grams)
                if words >= WORDS_PER_BATCH or len(measures) >= DOCS_PER_BATCH:
                    yield from flush()
                    number, words = number + 1, 0
                    held, places, seen, measures = [], [], set(), []
        if measures:
            yield from flush()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(deal, schema)


def _batch(block, batch, grams, places, doc_id, size, digest, text_hash) -> pa.RecordBatch:
    n = len(block)
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    columns = (block, batch, grams, places, doc_id, size, digest, text_hash)
    arrays = [pa.nulls(n, kind) if c is None else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "batch", "grams", "places", "doc_id", "size", "digest", "text_hash"])


def _planes(owner: np.ndarray) -> bytes:
    """High bytes, then low bytes of the steps between owners: both repeat and compress well."""
    steps = np.diff(owner, prepend=np.uint16(0)).astype("<u2")
    return steps.view(np.uint8).reshape(-1, 2).T.tobytes()


def _owners(planes: bytes) -> np.ndarray:
    steps = np.frombuffer(planes, np.uint8).reshape(2, -1).T.copy().view("<u2").ravel()
    return np.cumsum(steps.astype(np.int64))


def _shared_columns(dealt: DataFrame) -> DataFrame:
    """``uid, doc_id, size, digest, text_hash`` of every document and ``uid, gram`` of every n-gram that
    two texts of a column block hold. A block beyond ``ENTRIES_HELD`` is passed on whole:
    the pass only thins out, so what follows stays exact."""
    schema = "uid long, doc_id long, size int, digest long, text_hash long, gram long"
    names = ["uid", "doc_id", "size", "digest", "text_hash", "gram"]

    def out(uid: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(uid), kind) for kind in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(uid), *none, pa.array(gram)], names=names)

    def shared(gram: np.ndarray, uid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(gram)
        gram = gram[order]
        same = gram[1:] == gram[:-1]
        keep = np.zeros(len(gram), bool)
        keep[1:] |= same
        keep[:-1] |= same
        return uid[order][keep], gram[keep]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, grams, uids, held, whole = None, [], [], 0, False

        def close() -> Iterator[pa.RecordBatch]:
            if grams:
                uid, gram = (np.concatenate(uids), np.concatenate(grams)) if whole else shared(np.concatenate(grams), np.concatenate(uids))
                for i in range(0, len(uid), 500_000):
                    yield out(uid[i : i + 500_000], gram[i : i + 500_000])

        for batch in batches:
            measures = batch.filter(pa.compute.less(batch.column(0), 0))
            if measures.num_rows:
                columns = [measures.column(i) for i in (1, 4, 5, 6, 7)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(measures.num_rows, pa.int64())], names=names)
            for block, first, low, planes in zip(*(batch.column(i) for i in range(4)), strict=True):
                block = block.as_py()
                if block < 0:
                    continue
                if block != current:
                    yield from close()
                    current, grams, uids, held, whole = block, [], [], 0, False
                raw = np.frombuffer(low.as_buffer(), np.uint8).reshape(-1, LOW_BITS // 8)
                gram = np.zeros((len(raw), 8), np.uint8)
                gram[:, : LOW_BITS // 8] = raw
                grams.append(gram.view("<i8").ravel() | block << LOW_BITS)
                uids.append(_owners(planes.as_buffer()) | first.as_py())
                held += len(raw)
                if held > ENTRIES_HELD:
                    whole = True
                    yield from close()
                    grams, uids, held = [], [], 0
        yield from close()

    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(scan, schema)


def _least(size: str) -> str:
    """SQL for the smallest overlap that a set of this size can have with a partner."""
    return f"cast((({PERCENT} * {size}) + 99) div 100 as int)"


def _clusters(entries: DataFrame) -> DataFrame:
    """``uid, component`` of rows that may be linked, from ``uid, size, n_shared, gram, df``.

    Two rows that reach the bound share an n-gram among the rarest ``n_shared - least + 1``
    of each, in the order by frequency that all rows use.
    """
    rare = Window.partitionBy("uid").orderBy("df", "gram")
    prefix = entries.withColumn("_place", F.row_number().over(rare)).filter(F.col("_place") <= F.col("n_shared") - F.expr(_least("size")) + 1)
    prefix = cut(prefix.select("uid", "gram"), "rare_grams")
    first = prefix.groupBy("gram").agg(F.min("uid").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return components(prefix.join(first, "gram").select(F.col("uid").alias("a"), "b"))


def overlaps(rows: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """Counts of common columns for all pairs of ``n`` rows. Full columns are multiplied as
    dense matrices, thin ones add one to each of their pairs."""
    _, column, filled = np.unique(grams, return_inverse=True, return_counts=True)
    counts = np.zeros((n, n), np.float32)
    dense = filled >= DENSE
    if dense.any():
        place = np.cumsum(dense) - 1
        here = dense[column]
        r, c = rows[here], place[column[here]]
        for start in range(0, int(dense.sum()), 2048):
            part = (c >= start) & (c < start + 2048)
            matrix = np.zeros((n, 2048), np.float32)
            matrix[r[part], c[part] - start] = 1
            counts += matrix @ matrix.T
    thin = ~dense[column] & (filled[column] > 1)
    order = np.argsort(column[thin], kind="stable")
    r, c = rows[thin][order], column[thin][order]
    for step in range(1, DENSE):
        same = c[step:] == c[:-step] if step < len(c) else np.zeros(0, bool)
        if not same.any():
            break
        a, b = r[:-step][same], r[step:][same]
        np.add.at(counts, (a, b), 1)
        np.add.at(counts, (b, a), 1)
    return counts


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Member and root of each connected group of a symmetric link matrix."""
    out, seen = [], np.zeros(len(linked), bool)
    for root in np.flatnonzero(linked.any(axis=1)):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            seen[front] = True
            out += [(int(x), int(root)) for x in front]
    return out


def _linked(product: pa.Table) -> pa.Table:
    """Links inside one product of two row blocks, as a forest."""
    uid = product.column("uid").to_numpy()
    size = product.column("size").to_numpy().astype(np.float64)
    side = product.column("side").to_numpy()
    lists = product.column("grams").combine_chunks()
    n = len(uid)
    rows = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    common = overlaps(rows, lists.flatten().to_numpy(), n)
    # Counts are float32, exact up to 2^24; the test itself must be in doubles.
    both = size[:, None] + size[None, :]
    both *= PERCENT
    linked = common.astype(np.float64) * (100 + PERCENT) >= both
    np.fill_diagonal(linked, False)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    pairs = forest(linked)
    a, b = ([uid[p[i]] for p in pairs] for i in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _products(sets: DataFrame) -> DataFrame:
    """Every row sent to the products of its block, from ``uid, component, size, grams``.

    A cluster is dealt by size bands, so that only rows of one or of neighbouring bands can
    be linked, and a band by hash into blocks of bounded rows and n-grams. A row is repeated
    once per block that its own block is multiplied with.
    """
    ratio = math.log(100 / PERCENT)
    banded = sets.withColumn("band", F.floor(F.log("size") / ratio + 1e-9).cast("int"))
    total = Window.partitionBy("component")
    measured = banded.groupBy("component", "band").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("grams")).alias("grams_"))
    whole = (F.sum("rows").over(total) <= ROWS_PER_BLOCK) & (F.sum("grams_").over(total) <= GRAMS_PER_BLOCK)
    blocks = F.ceil(F.greatest(F.col("rows") / ROWS_PER_BLOCK, F.col("grams_") / GRAMS_PER_BLOCK)).cast("int")
    order = Window.partitionBy("component").orderBy("band").rangeBetween(1, 1)
    prior = Window.partitionBy("component").orderBy("band").rangeBetween(-1, -1)
    plan = measured.withColumn("whole", whole).withColumn("blocks", F.when(F.col("whole"), 1).otherwise(blocks))
    plan = plan.withColumn("above", F.when(F.col("whole"), 0).otherwise(F.coalesce(F.max("blocks").over(order), F.lit(0))))
    plan = plan.withColumn("below", F.when(F.col("whole"), 0).otherwise(F.coalesce(F.max("blocks").over(prior), F.lit(0)))).drop("rows", "grams_")
    rows = banded.join(plan, ["component", "band"]).withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("band", F.when(F.col("whole"), 0).otherwise(F.col("band")))
    to = lambda low, i, high, j, side: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), F.lit(side).alias("side"))
    band, own = F.col("band"), F.col("own")
    none = "array<struct<low:int,i:int,high:int,j:int,side:int>>"
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast(none))
    inside = F.concat(
        F.filter(upto(F.col("blocks"), lambda j: to(band, own, band, j, 0)), lambda x: x["i"] <= x["j"]),
        F.filter(upto(F.col("blocks"), lambda j: to(band, j, band, own, 1)), lambda x: x["i"] < x["j"]),
    )
    beside = F.concat(
        upto(F.col("above"), lambda j: to(band, own, band + 1, j, 0)), upto(F.col("below"), lambda j: to(band - 1, j, band, own, 1))
    )
    return rows.select("component", "uid", "size", "grams", F.inline(F.concat(inside, beside)))


def _grouped(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, size, digest, text_hash`` of every document, and ``digest, component,
    component_id`` of every text with words (equal sets of n-grams are one text)."""
    letters = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(6, math.ceil(math.log2(max(1, letters / 6 / ENTRIES_PER_BLOCK))))
    found = cut(_shared_columns(_dealt(docs, bits, width)), "shared_grams")
    measures = found.filter("gram is null").select("uid", "doc_id", "size", "digest", "text_hash")
    texts = cut(
        measures.filter("digest is not null").groupBy("digest").agg(F.min("uid").alias("uid"), F.first("size").alias("size"), F.min("doc_id").alias("least_id")),
        "texts",
    )
    rows = found.filter("gram is not null").select("uid", "gram").join(texts.select("uid", "size"), "uid")
    columns = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = rows.join(columns, "gram")
    enough = shared.groupBy("uid").agg(F.count(F.lit(1)).cast("int").alias("n_shared"), F.first("size").alias("_size")).filter(f"n_shared >= {_least('_size')}").drop("_size")
    entries = cut(shared.join(enough, "uid"), "incidence")
    clusters = _clusters(entries)
    sets = entries.groupBy("uid").agg(F.first("size").alias("size"), F.collect_list("gram").alias("grams"))
    sets = cut(sets.join(clusters.select(F.col("node").alias("uid"), "component"), "uid"), "rows")
    keys = ["component", "low", "i", "high", "j"]
    links = cut(_products(sets).groupBy(*keys).applyInArrow(lambda table: _linked(table), "a long, b long"), "ngram_links")
    groups = components(links).withColumnRenamed("node", "uid")
    labelled = texts.join(groups, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return measures, labelled.join(least, "component").select("digest", "component", "component_id")


def ngram_jaccard(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document.

    Null and empty texts have no n-grams and are linked with nothing. Copies form one row of
    the matrix and are linked with each other. Repeated rows stay; a null id counts in no
    minimum (a group of null ids alone has a null component); an empty table gives no rows;
    columns other than ``doc_id, text`` are not read.
    """
    measures, labels = _grouped(docs, width)
    out = measures.join(labels.drop("component"), "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """``docs`` with one row per group of linked texts: that with the smallest id, and among
    unequal texts under that id the one with the smallest hash. An id that stands for several
    texts is decided text by text.

    Equal texts under one id are one row, also without words. Documents without words and
    rows without an id, which cannot be told apart, stay. Any other columns are handed on as
    they are, whatever their names; an empty table gives no rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_")).alias("others"))
    known = packed.filter("doc_id is not null")
    measures, labels = _grouped(known.select("doc_id", "text"), width)
    place = F.struct("doc_id", "text_hash")
    chosen = measures.join(labels.select("digest", "component"), "digest").groupBy("component").agg(F.min(place).alias("place"))
    wordless = measures.filter("digest is null").select(place.alias("place")).distinct()
    kept = chosen.select("place.*").unionByName(wordless.select("place.*"))
    same = Window.partitionBy("doc_id", "text_hash").orderBy("doc_id")
    rows = known.withColumn("text_hash", F.xxhash64("text")).join(kept, ["doc_id", "text_hash"], "left_semi")
    first = rows.withColumn("nth", F.row_number().over(same)).filter("nth = 1")
    out = first.select("doc_id", "text", "others").unionByName(packed.filter("doc_id is null"))
    columns = [F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns)
