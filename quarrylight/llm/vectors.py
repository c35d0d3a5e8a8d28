"""The most similar vectors of every vector, by a permutation index.

Plan
----
1. Vectors of the right width without null, NaN or infinite elements and with a
   length above zero are scaled to unit length.  Equal vectors form a class;
   only one vector per class is indexed.
2. ``pivots`` vectors, a bounded sample drawn by a hash of the id, are the
   index's only fitted part.  A vector is represented by its ``prefix`` nearest
   pivots in order (a permutation prefix).
3. It is posted in inverted files, each for a pair of its ``post`` nearest
   pivots (see ``pivot_pairs``).  The number of pivots grows with the square root of the number of
   vectors, so the files keep their size (some 60 rows) as the data grow.
4. Inside a file every two vectors (up to ``max_footrule`` apart, if that is
   given) are scored with the 8-bit vectors that the postings carry.  Rounding
   moves a vector by a known length at most, so a score is an interval of
   distances.
5. A pair goes on unless k others of both its vectors are surely nearer; those
   that do are reranked with the full vectors and reduced to k.  So only the
   choice of files loses neighbours, never the scores.

Files of any size are handled in bounded units (see ``blocks``).

Among nearly independent vectors the nearest share a file no more often than
others, so lists without a threshold need every pair: ``exhaustive`` compares
all classes in rounds of bounded size, which is exact and costs the square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.llm.blocks import PROBED, binary_rows, bucket_units, fixed_bytes, hot_keys, one_per, probe, ragged_pairs, unit_starts, whole_units
from quarrylight.session import materialise

SCALE = 32767  # vectors are held in 16-bit fixed point: similarities are right to about 1e-5
STEPS = 15000  # to a unit of distance in the bounds of pairs, two bytes each
ROUND = 262_144  # classes sent to all tasks at once in an exhaustive search: 36 MB at width 64
MAX_PIVOTS = 65_536  # bound of the sample that the driver holds (16 MB at width 64), reached at 21 billion vectors


def unit_matrix(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors and the vectors at unit length."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(rows), width)  # null elements have become NaN
    length = np.sqrt((matrix**2).sum(1))
    good = np.isfinite(length) & (length > 0)
    return rows[good], matrix[good] / length[good, None]


def unit_vectors(vectors: DataFrame, key: str, embedding: str, width: int) -> DataFrame:
    """``(id, class, vec)`` of the usable vectors; vec holds the unit vector in fixed point."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, matrix = unit_matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), binary_rows(np.rint(matrix * SCALE).astype(np.int16))], ["id", "vec"]
            )

    usable = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(embedding).alias("embedding"))
    kind = vectors.schema[key].dataType.simpleString()
    return usable.mapInArrow(scale, f"id {kind}, vec binary").withColumn("class", F.xxhash64("vec"))


def choose_pivots(vectors: DataFrame, key: str, embedding: str, width: int, count: int) -> np.ndarray:
    """The pivots: the first usable vectors in the order of a hash of their ids."""
    drawn = (
        vectors.filter(F.col(key).isNotNull() & (F.size(embedding) == width))
        .select(embedding, F.xxhash64(F.lit("pivot"), key).alias("at"))
        .orderBy("at")
        .limit(2 * count + 16)
        .toArrow()
    )
    _, matrix = unit_matrix(drawn.column(embedding), width)
    _, first = np.unique(matrix.round(6), axis=0, return_index=True)
    return matrix[np.sort(first)][:count].astype(np.float32)


def pivot_pairs(post: int) -> list[tuple[int, int]]:
    """The pairs of places in the permutation that name a vector's inverted files.

    Pairs of late places are left out: they join few near vectors that no
    earlier pair joins.
    """
    return [(x, y) for x, y in combinations(range(post), 2) if x + y < post]


def file_keys(perm: np.ndarray, post: int, m: int) -> np.ndarray:
    """The numbers of the inverted files of each permutation (one per column)."""
    x, y = (perm[:, list(c)].astype(np.int64) for c in zip(*pivot_pairs(post)))
    return np.minimum(x, y) * m + np.maximum(x, y)


def postings(classes: DataFrame, pivots: np.ndarray, width: int, prefix: int, post: int) -> DataFrame:
    """``(key, class, packed)``: one row per inverted file a vector is posted in; packed holds its permutation and its 8-bit vector."""
    m = len(pivots)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = fixed_bytes(batch.column(1), width * 2).copy().view(np.int16).astype(np.float32) / SCALE
            near = matrix @ pivots.T
            top = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
            order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
            perm = np.take_along_axis(top, order, 1).astype(np.uint16)
            both = binary_rows(np.concatenate((perm.view(np.uint8), coarse(matrix).view(np.uint8)), axis=1))
            for key in file_keys(perm, post, m).T:
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), both], ["key", "class", "packed"])

    return classes.mapInArrow(rows, "key long, class long, packed binary")


def coarse(matrix: np.ndarray) -> np.ndarray:
    """The directions of vectors in 8 bits, the largest element being 127."""
    return np.rint(matrix * (127 / np.abs(matrix).max(1, keepdims=True))).astype(np.int8)


def coarse_lengths(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of 8-bit vectors and the distance at most between the unit vectors before and after rounding."""
    length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    sine = np.minimum(0.5 * np.sqrt(q.shape[1]) / length, 1.0)  # each element is rounded by half a step at most
    return length, np.sqrt(2 - 2 * np.sqrt(1 - sine**2)) + 1e-6


def footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Footrule distance of permutation prefixes, a missing pivot ranking last."""
    t = a.shape[1]
    shared = np.zeros(len(a), np.int16)
    for i in range(t):
        for j in range(t):
            shared += (a[:, i] == b[:, j]) * np.int16(t - max(i, j))
    return t * (t + 1) - 2 * shared


def within_reach(owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Mask of the intervals that begin before k of their owner have surely ended."""
    order = np.lexsort((high, owner))
    ordered = owner[order]
    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    size = np.diff(np.append(start, len(order)))
    bound = high[order[start + np.minimum(size, k) - 1]]
    mask = np.zeros(len(order), bool)
    mask[order] = low[order] <= np.repeat(bound, size)
    return mask


def file_pairs(
    posted: DataFrame, width: int, prefix: int, post: int, m: int, k: int, max_footrule: int | None, least: float | None, block: int, hot: DataFrame
) -> DataFrame:
    """``(a, b, low, high)`` with a < b: the pairs of each file that are worth reranking, and bounds of their distance.

    A pair is given by the first of the files that it shares, so only once.
    """
    farthest = None if least is None else np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_units(batches, "key"):
            starts = unit_starts(part, "key")
            ends = np.append(starts[1:], part.num_rows)
            packed = fixed_bytes(part.column("packed"), prefix * 2 + width)
            perm, q = packed[:, : prefix * 2].copy().view(np.uint16), packed[:, prefix * 2 :].copy().view(np.int8)
            length, moved = coarse_lengths(q)
            files = np.sort(file_keys(perm, post, m), axis=1)
            key, classes, u, v, blk = (part.column(c).to_numpy() for c in ("key", "class", "u", "v", "blk"))
            for i, j in ragged_pairs(starts, ends):
                ok = (u[i] == v[i]) | (blk[i] != blk[j])
                i, j = i[ok], j[ok]
                if max_footrule is not None:
                    ok = footrule(perm[i], perm[j]) <= max_footrule
                    i, j = i[ok], j[ok]
                if len(i) == 0:
                    continue
                dot = np.concatenate(
                    [
                        np.einsum("ij,ij->i", q[i[s : s + 65536]].astype(np.float32), q[j[s : s + 65536]].astype(np.float32))
                        for s in range(0, len(i), 65536)
                    ]
                )  # whole numbers below 2^24, so exact
                distance = np.sqrt(np.maximum(0.0, 2 - 2 * dot / (length[i] * length[j])))
                error = moved[i] + moved[j]
                low = np.floor((distance - error) * STEPS).astype(np.int16)
                high = np.ceil((distance + error) * STEPS).astype(np.int16)
                if farthest is not None:
                    ok = low <= farthest * STEPS
                    i, j, low, high = i[ok], j[ok], low[ok], high[ok]
                # before any choice among pairs: what one file leaves out no other gives
                first = np.ones(len(i), bool)
                for f in files.T:  # a file named before this one by both
                    earlier = f[i] < key[i]
                    first &= ~(earlier & (files[j] == f[i][:, None]).any(1))
                i, j, low, high = i[first], j[first], low[first], high[first]
                if len(i) == 0:
                    continue
                ok = within_reach(i, low, high, k) | within_reach(j, low, high, k)
                a, b = classes[i[ok]], classes[j[ok]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(low[ok]), pa.array(high[ok])], ["a", "b", "low", "high"]
                )

    units = bucket_units(posted, "key", "class", block, hot)
    return units.mapInArrow(compare, "a long, b long, low short, high short")


def best_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The pairs ``(a, b)`` of which a or b has fewer than k that are surely nearer."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("owner"), F.col("b").alias("other")), F.struct(F.col("b").alias("owner"), F.col("a").alias("other"))))
    both = pairs.select(ends.alias("e"), "low", "high").select("e.owner", "e.other", "low", "high")  # small rows: all of them are shuffled
    place = F.row_number().over(W.partitionBy("owner").orderBy("high"))
    bound = F.max(F.when(F.col("place") <= k, F.col("high"))).over(W.partitionBy("owner"))
    near = both.withColumn("place", place).withColumn("bound", bound).filter(F.col("low") <= F.col("bound"))
    kept = near.select(F.least("owner", "other").alias("a"), F.greatest("owner", "other").alias("b"))
    return kept.repartition("a").dropDuplicates(["a", "b"])  # laid out for the join on a that follows


def rerank(pairs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``(a, b, similarity)`` from the full vectors."""

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (fixed_bytes(batch.column(c), width * 2).copy().view(np.int16).astype(np.float64) for c in (2, 3))
            cosine = np.einsum("ij,ij->i", x, y) / np.sqrt((x**2).sum(1) * (y**2).sum(1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], ["a", "b", "similarity"])

    left = classes.select(F.col("class").alias("a"), F.col("vec").alias("x")).hint("merge")
    right = classes.select(F.col("class").alias("b"), F.col("vec").alias("y")).hint("merge")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(dot, "a long, b long, similarity double")


def all_near(classes: DataFrame, width: int, k: int, size: int) -> DataFrame:
    """``(a, b, similarity)``: of each class a the k most similar others among each ``size`` classes, with ties, by all pairs."""
    held = materialise(classes, "classes")
    count = held.count()
    rounds = max(1, -(-count // size))
    spread = held.repartition(max(1, -(-count // 2048)), "class")
    parts = []
    for r in range(rounds):
        drawn = held.filter(F.pmod(F.xxhash64("class", F.lit("round")), F.lit(rounds)) == r).toArrow()
        other = drawn.column("class").to_numpy()
        whole = fixed_bytes(drawn.column("vec"), width * 2).copy().view(np.int16)
        shared = held.sparkSession.sparkContext.broadcast((other, whole))
        parts.append(spread.mapInArrow(round_search(shared, width, k), "a long, b long, similarity double"))
    return reduce(DataFrame.unionByName, parts)


def round_search(shared, width: int, k: int):
    """The task that compares its classes with those of a round."""

    def unit(whole: np.ndarray) -> np.ndarray:
        return (whole / np.sqrt((whole.astype(np.float64) ** 2).sum(1, keepdims=True))).astype(np.float32)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other, whole = shared.value
        n, groups = len(other), max(64, 8 * (k + 1))
        if n == 0:
            return
        near = np.ascontiguousarray(unit(whole).T)
        for batch in batches:
            own = batch.column(0).to_numpy()
            vec = fixed_bytes(batch.column(1), width * 2).copy().view(np.int16)
            step = max(1, 16_000_000 // n)
            for s in range(0, len(own), step):
                score = unit(vec[s : s + step]) @ near
                # k + 1 columns (one may be the class itself) reach this bound, which is the exact one but for 32-bit rounding
                width_of = n // groups
                best = score[:, : width_of * groups].reshape(len(score), groups, width_of).max(1) if width_of > 8 * (k + 1) else score
                rest = min(k + 1, best.shape[1])
                bound = np.partition(best, best.shape[1] - rest, axis=1)[:, best.shape[1] - rest]
                i, j = np.nonzero(score >= bound[:, None] - np.float32(1e-5))
                x, y = vec[s + i].astype(np.float64), whole[j].astype(np.float64)
                exact = np.einsum("ij,ij->i", x, y) / np.sqrt((x**2).sum(1) * (y**2).sum(1))
                ok = own[s + i] != other[j]
                i, j, exact = i[ok], j[ok], exact[ok]
                if len(i) == 0:
                    continue
                ok = within_reach(i, -exact, -exact, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[s + i[ok]]), pa.array(other[j[ok]]), pa.array(exact[ok])], ["a", "b", "similarity"])

    return search


def indexed_near(
    vectors: DataFrame,
    classes: DataFrame,
    key: str,
    embedding: str,
    k: int,
    width: int,
    min_similarity: float | None,
    pivots: int | None,
    prefix: int,
    post: int,
    max_footrule: int | None,
    block: int,
) -> DataFrame:
    """``(a, b, similarity)`` with a < b: the pairs of classes that the index finds."""
    count = vectors.count()
    pivots = pivots or int(min(MAX_PIVOTS, max(16, 0.45 * count**0.5)))
    chosen = choose_pivots(vectors, key, embedding, width, pivots)
    prefix = min(prefix, len(chosen))
    post = min(post, prefix)
    if post >= 2:
        if max_footrule is None:
            prefix = post  # the later places name no file
        posted = postings(classes, chosen, width, prefix, post)
        hot = hot_keys(postings(probe(classes, "vec"), chosen, width, prefix, post), "key", times=PROBED)
        pairs = file_pairs(posted, width, prefix, post, len(chosen), k, max_footrule, min_similarity, block, hot)
    else:  # fewer than two different vectors, so no pair of classes
        alone = classes.select(F.col("class").alias("a"))
        pairs = alone.withColumn("b", F.col("a")).withColumn("low", F.lit(0)).withColumn("high", F.lit(0)).limit(0)
    return rerank(best_pairs(pairs, k), classes, width)


def nearest_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    k: int = 10,
    width: int = 64,
    min_similarity: float | None = None,
    pivots: int | None = None,
    prefix: int = 6,
    post: int = 5,
    max_footrule: int | None = None,
    block: int = 2048,
    exhaustive: bool = False,
    size: int = ROUND,
) -> DataFrame:
    """``(id, other, similarity, rank)``: the k most similar other vectors of each.

    Ties go to the smaller id.  Null, zero, non-finite and wrong-width vectors
    and null ids take no part; a repeated id with equal vectors counts once.
    With ``min_similarity`` only neighbours at least so similar are given (and
    looked for).  An empty table gives no row; extra columns are ignored.  The
    index is approximate: recall is measured in the tests.  ``exhaustive`` compares
    all pairs instead, in rounds of ``size`` classes, and loses nothing.
    """
    units = unit_vectors(vectors, key, embedding, width)
    classes = one_per(units.select("class", "vec"), "class")
    if exhaustive:
        both = all_near(classes, width, k, size)
    else:
        exact = indexed_near(vectors, classes, key, embedding, k, width, min_similarity, pivots, prefix, post, max_footrule, block)
        both = exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    if min_similarity is not None:
        both = both.filter(F.col("similarity") >= min_similarity)

    ids = units.select("id", "class").distinct()
    w = W.partitionBy("class")
    placed = ids.withColumn("place", F.row_number().over(w.orderBy("id"))).withColumn("n", F.count(F.lit(1)).over(w))
    first = placed.filter(F.col("place") <= k + 1)
    copies = first.filter(F.col("place") == 2).select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(2.0).alias("similarity"))
    near = both.unionByName(copies).join(first.select(F.col("class").alias("b"), F.col("id").alias("other")), "b")
    by_class = W.partitionBy("a").orderBy(F.desc("similarity"), "other")
    best = near.withColumn("at", F.row_number().over(by_class)).filter(F.col("at") <= k + 1)
    # all members of a class share its list, which begins with the class's own
    # members (marked by similarity 2); a member's place in it is left out
    listed = placed.join(best.select(F.col("a").alias("class"), "other", "similarity", "at"), "class")
    ranked = listed.filter(F.col("id") != F.col("other")).withColumn(
        "rank", F.col("at") - ((F.col("n") > 1) & (F.col("place") < F.col("at"))).cast("int")
    )
    return ranked.filter(F.col("rank") <= k).select("id", "other", F.least("similarity", F.lit(1.0)).alias("similarity"), "rank")
