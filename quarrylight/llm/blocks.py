"""Comparing the members of buckets with each other, whatever the buckets' sizes.

Index structures (inverted files, tries) reduce a similarity join to buckets of
rows that share a key.  ``bucket_units`` turns the buckets into work units of
bounded size: a bucket of at most ``limit`` rows is one unit, a larger one is
split into blocks of about ``limit`` rows and every pair of blocks becomes a
unit of its own, so that a hot key is spread over many tasks and no member is
dropped.  Keys that hold a large share of all rows (``hot_keys``) are split
before they are shuffled for the first time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_per(rows: DataFrame, key: str) -> DataFrame:
    """One row per key, for keys whose rows are all equal.

    A window rather than an aggregate: Spark recognises the shuffles of plans
    above it as the same when the result is used several times.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(key))
    return rows.filter(F.col(key).isNotNull()).withColumn("place", place).filter(F.col("place") == 1).drop("place")


def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    """The batches, then a mark of the end."""
    for batch in batches:
        yield False, batch
    yield True, None


COUNTED = 500_000  # keys that a task counts at a time
PROBED = 16  # one row of so many tells the hot keys where finding the keys is costly


def probe(rows: DataFrame, column: str) -> DataFrame:
    """One row of ``PROBED``, by a hash of a column.  It only decides how work is cut, never what is found."""
    return rows.filter(F.pmod(F.xxhash64(column), F.lit(PROBED)) == 0)


def hot_keys(rows: DataFrame, key: str, share: float = 1 / 512, times: int = 1) -> DataFrame:
    """``(hot, n)``: keys with about ``share`` of all rows or more, and about how many rows they have.

    A key with such a share has it in some task: every task counts its keys and
    gives those with half the share and the number of its rows, so only a few
    rows are shuffled.  At most 4 / share keys come out, which bounds the table
    for a broadcast.  ``times`` multiplies the numbers where the rows are a
    ``probe``; a key that a probe misses is split after its first shuffle.
    """

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        held: list[np.ndarray] = []
        for last, batch in ended(batches):
            if batch is not None:
                held.append(batch.column(0).drop_null().to_numpy())
                total += len(held[-1])
            if held and (last or sum(map(len, held)) > COUNTED):
                k, c = np.unique(np.concatenate(held), return_counts=True)
                keys, where = np.unique(np.concatenate((keys, k)), return_inverse=True)
                counts = np.bincount(where, np.concatenate((counts, c))).astype(np.int64)
                if len(keys) > COUNTED:  # every count falls by what the least of the rest has: by one in COUNTED rows at most
                    counts -= np.partition(counts, len(counts) - COUNTED - 1)[len(counts) - COUNTED - 1]
                    keys, counts = keys[counts > 0], counts[counts > 0]
                held = []
        if total:
            top = counts >= max(2, share / 2 * total)
            yield pa.RecordBatch.from_arrays([pa.array(keys[top]), pa.array(counts[top])], ["hot", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], ["hot", "n"])

    found = rows.select(key).mapInArrow(heavy, "hot long, n long").groupBy("hot").agg(F.sum("n").alias("n"))
    few = found.withColumn("every", F.sum(F.when(F.col("hot").isNull(), F.col("n"))).over(W.partitionBy()))  # 2 / share rows a task at most
    return few.filter(F.col("hot").isNotNull() & (F.col("n") >= share / 4 * F.col("every"))).select("hot", (F.col("n") * times).alias("n"))


def with_blocks(rows: DataFrame, hot: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """Adds ``blocks``, the number of blocks of a hot key (null for other keys), and ``blk``, the row's block."""
    blocks = F.when(F.col("n") > limit, F.ceil(F.col("n") / limit).cast("int"))
    near = rows.join(F.broadcast(hot), F.col(key) == F.col("hot"), "left")  # bounded, see hot_keys
    return near.withColumn("blocks", blocks).withColumn("blk", F.coalesce(F.pmod(F.xxhash64(order), F.col("blocks")).cast("int"), F.lit(0))).drop("hot", "n")


def bucket_units(rows: DataFrame, key: str, order: str, limit: int, hot: DataFrame | None = None) -> DataFrame:
    """Rows of buckets with at least two members, plus ``u, v, blk``.

    ``(key, u, v)`` names the unit and ``blk`` the row's block in it (u or v).
    The result is sorted by unit inside each partition and a unit never spans
    partitions.  Keys are whole numbers; ``hot`` holds the hot ones, if known.
    """

    def units(big: DataFrame) -> DataFrame:
        """Every row with every block of its bucket, the rows of a unit together."""
        return (
            big.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(*rows.columns, F.least("blk", "other").alias("u"), F.greatest("blk", "other").alias("v"), "blk")
            .repartition(key, "u", "v")
            .sortWithinPartitions(key, "u", "v")
        )

    marked = with_blocks(rows, hot_keys(rows, key) if hot is None else hot, key, order, limit)
    rest = marked.filter(F.col("blocks").isNull()).select(*rows.columns)
    w = W.partitionBy(key)
    counted = rest.withColumn("pos", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    small = counted.filter(F.col("n").between(2, limit)).select(
        *rows.columns, F.lit(0).alias("u"), F.lit(0).alias("v"), F.lit(0).alias("blk")
    )
    large = counted.filter(F.col("n") > limit).withColumns(
        {"blk": (F.col("pos") / limit).cast("int"), "blocks": F.ceil(F.col("n") / limit).cast("int")}
    )
    columns = [*rows.columns, "blocks", "blk"]
    return small.unionByName(units(large.select(*columns).unionByName(marked.filter(F.col("blocks").isNotNull()).select(*columns))))


def whole_units(batches: Iterator[pa.RecordBatch], key: str, rows: int = 50_000) -> Iterator[pa.Table]:
    """Regroup Arrow batches so that each yielded table holds whole units."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        joined = pa.Table.from_batches(held).combine_chunks()
        starts = unit_starts(joined, key)
        cut = int(starts[-1])
        if cut:
            yield joined.slice(0, cut)
        rest = joined.slice(cut)
        held = rest.combine_chunks().to_batches()
        size = rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def unit_starts(table: pa.Table, key: str) -> np.ndarray:
    """Row numbers at which a new unit begins."""
    k, u, v = (table.column(c).to_numpy() for c in (key, "u", "v"))
    new = (k[1:] != k[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def fixed_bytes(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as a matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.binary())
    if len(array) == 0:
        return np.zeros((0, width), np.uint8)
    offsets = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4)
    data = np.frombuffer(array.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]].reshape(len(array), width)


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """A matrix of bytes as a binary column, one value per row."""
    matrix = np.ascontiguousarray(matrix)
    n, width = len(matrix), matrix.shape[1] * matrix.itemsize
    offsets = (np.arange(n + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())])


def ragged_pairs(starts: np.ndarray, ends: np.ndarray, step: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All row pairs i < j inside each run [start, end), about ``step`` at a time."""
    rows = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)]) if len(starts) else np.zeros(0, np.int64)
    left = np.repeat(ends, ends - starts) - rows - 1  # partners after each row
    total = np.cumsum(left)
    begin = 0
    while begin < len(rows):
        base = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, base + step, "right")))
        count = left[begin:stop]
        i = np.repeat(rows[begin:stop], count)
        first = np.repeat(np.cumsum(count) - count, count)
        yield i, i + 1 + (np.arange(len(i)) - first)
        begin = stop
