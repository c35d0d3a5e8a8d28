"""Exact nearest vectors of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.best import Best, eligible, query_blocks, top_k

BLOCK = 16_384  # query vectors broadcast at once: 8 MB at width 64


def unit_rows(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors (float64) of the usable lists."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(rows), width)
    length = np.sqrt((matrix**2).sum(1))
    good = np.isfinite(length) & (length > 0)
    return rows[good], matrix[good] / length[good, None]


def usable_vectors(vectors: DataFrame, width: int = 64) -> DataFrame:
    """``(chunk_id, vec_id, embedding)``: the right width, finite, not zero.  Repeated rows stay; ``nearest`` counts an id once."""
    e = F.col("embedding")
    fine = (F.size(e) == width) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & fine).select("chunk_id", "vec_id", "embedding")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, width: int = 64) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: exact cosine top k, ties to the smaller chunk id.

    ``queries`` has ``query_id`` and ``embedding``, and both sides may have
    ``company`` (met case by case) and ``fiscal_year``: a hit must have what
    its query demands.  Queries are searched in blocks of ``BLOCK``; each task
    keeps only its own k best before the shuffle, the vectors stay where they
    are.  A chunk id that comes more than once counts once.
    """
    for name, kind_ in (("company", "string"), ("fiscal_year", "int")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind_))
        if name not in vectors.columns:
            vectors = vectors.withColumn(name, F.lit(None).cast(kind_))
    kind = queries.schema["query_id"].dataType.simpleString()
    placed = queries.select("query_id", "embedding", "company", F.col("fiscal_year").cast("int").alias("fiscal_year"))
    source = vectors.select("chunk_id", "embedding", "company", F.col("fiscal_year").cast("int").alias("fiscal_year"))
    parts = []
    for held in query_blocks(placed, BLOCK):
        rows, matrix = unit_rows(held.column("embedding"), width) if held.num_rows else (np.zeros(0, int), np.zeros((0, width)))
        held = held.take(pa.array(rows, pa.int64()))
        one = [pa.concat_arrays(held.column(c).chunks) if held.num_rows else pa.array([], held.schema.field(c).type) for c in ("query_id", "company", "fiscal_year")]
        shared = queries.sparkSession.sparkContext.broadcast((*one, matrix))
        parts.append(source.mapInArrow(block_search(shared, k, width), f"query_id {kind}, chunk_id string, score double"))
    return top_k(reduce(DataFrame.unionByName, parts), k, ["query_id"])


def block_search(shared, k: int, width: int):
    """The task that keeps the best of its vectors for each query of a block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, companies, years, matrix = shared.value
        if len(matrix) == 0:
            return
        best = Best(k, len(ids))
        step = max(64, 8_000_000 // len(ids))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                rows, vectors = unit_rows(batch.column("embedding"), width)
                if len(rows) == 0:
                    continue
                taken = batch.take(pa.array(rows))
                score = vectors @ matrix.T
                score[~eligible(taken.column("company"), taken.column("fiscal_year"), companies, years)] = -np.inf
                best.add(score, taken.column("chunk_id"))
        yield from best.rows_of(ids)

    return search
