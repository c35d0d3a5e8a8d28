"""The k best rows per query, kept inside a task before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(scores: DataFrame, k: int, group: list[str], score: str = "score") -> DataFrame:
    """The k best rows of each group with their ``rank``; ties go to the smaller chunk id."""
    w = W.partitionBy(*group).orderBy(F.desc(F.round(score, 9)), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def query_blocks(queries: DataFrame, size: int) -> Iterator[pa.Table]:
    """The rows of a query table (``query_id`` and more) in blocks of about ``size`` rows for the driver to send out.

    Up to ``size`` rows take one read.
    """
    first = queries.limit(size + 1).toArrow()
    if first.num_rows <= size:
        yield first.combine_chunks()
        return
    blocks = -(-queries.count() // size)
    placed = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    for b in range(blocks):
        yield placed.filter(F.col("block") == b).drop("block").toArrow().combine_chunks()


class Best:
    """The k best of what a task has seen so far, for each query of a block.

    Scores compare rounded to nine places, ties go to the smaller id, and an id
    that comes more than once counts once.
    """

    def __init__(self, k: int, queries: int):
        self.k, self.limit = k, max(200_000, 4 * k * queries)
        self.held: list[pa.RecordBatch] = []
        self.rows = 0

    def add(self, score: np.ndarray, ids: pa.Array) -> None:
        """``score`` has a row per id and a column per query; -inf marks what a query does not take."""
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        named = ids.take(pa.array(order))
        names = named.to_numpy(zero_copy_only=False)
        fresh = np.ones(len(names), bool)
        fresh[1:] = names[1:] != names[:-1]
        named, score = named.filter(pa.array(fresh)), score[order[fresh]]
        if len(named) == 0:
            return
        rounded = score.round(9)
        keep = min(self.k, len(named))
        least = np.partition(rounded, len(named) - keep, axis=0)[len(named) - keep]
        above, level = rounded > least, rounded == least
        taken = above | (level & (np.cumsum(level, axis=0) <= keep - above.sum(0)))
        row, query = np.nonzero(taken & (score > -np.inf))
        self.held.append(
            pa.RecordBatch.from_arrays(
                [pa.array(query), pa.array(rounded[row, query]), named.take(pa.array(row)), pa.array(score[row, query])], ["q", "r", "id", "score"]
            )
        )
        self.rows += len(row)
        if self.rows > self.limit:
            self.held = self._best().to_batches()
            self.rows = sum(b.num_rows for b in self.held)

    def _best(self) -> pa.Table:
        every = pa.Table.from_batches(self.held).combine_chunks()
        every = every.sort_by([("q", "ascending"), ("r", "descending"), ("id", "ascending")])
        q, names = every.column("q").to_numpy(), every.column("id").to_numpy(zero_copy_only=False)
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (names[1:] != names[:-1])
        every = every.filter(pa.array(fresh))
        q = q[fresh]
        first = np.searchsorted(q, q)
        return every.filter(pa.array(np.arange(len(q)) - first < self.k)).combine_chunks()

    def rows_of(self, queries: pa.Array):
        """Record batches ``(query_id, chunk_id, score)`` of what is kept."""
        if self.held:
            table = self._best()
            named = queries.take(table.column("q").combine_chunks() if isinstance(table.column("q"), pa.ChunkedArray) else table.column("q"))
            if isinstance(named, pa.ChunkedArray):
                named = named.combine_chunks()
            yield from pa.table([named, table.column("id"), table.column("score")], ["query_id", "chunk_id", "score"]).to_batches()


def eligible(companies: pa.Array, years: pa.Array, asked_companies: pa.Array, asked_years: pa.Array) -> np.ndarray:
    """Mask (row x query): the row has the company and the year that the query demands; null demands nothing."""
    mask = np.ones((len(companies), len(asked_companies)), bool)
    for have, want in ((companies, asked_companies), (years, asked_years)):
        free = want.is_null().to_numpy(zero_copy_only=False)
        if free.all():
            continue
        names = want.drop_null().unique()
        a = pc.index_in(have, names).fill_null(-1).to_numpy(zero_copy_only=False)
        b = pc.index_in(want, names).fill_null(-2).to_numpy(zero_copy_only=False)
        mask &= free | (a[:, None] == b)
    return mask
