"""Texts that are nearly the same, by a binary-trie self-join over sketches.

Plan
----
1. Exact copies collapse first: a *class* is all rows with one text.  Only one
   text per class takes part in the join.
2. Each class gets its set of distinct token n-grams (24-bit hashes) and, from
   it, ``hashes`` minhash values.  Two low bits of each value form a binary
   code in which the share of differing bits estimates (1 - Jaccard) / 2.
3. The codes are held in ``bands`` tries.  The top of trie *b* is the hash of
   ``rows`` minhash values: there the error budget is zero, so Spark can
   partition on it.  Below it the code is walked in words of 16 bits: pairs of
   nodes are traversed together, differing bits accumulate, and a pair of nodes
   is dropped as soon as the Hamming budget is exceeded.
4. Pairs that survive in any trie are checked exactly on their n-gram sets.

With ``rows=3`` and ``bands=16`` a pair at similarity 0.6 meets in some trie
with probability 0.98, at 0.7 with 0.998; the Hamming budget keeps 3 standard
deviations of slack.  Buckets of any size are handled (see ``blocks``).  The
check is exact but for hash collisions: sets of a and b n-grams share about
a * b / 1.7e7 by chance, one in a thousand pairs of texts of 120 tokens.

Classes are named by the 64-bit xxhash of the text.  Two different texts among
n share a name with probability about n^2 / 3.7e19.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.blocks import PROBED, binary_rows, bucket_units, fixed_bytes, hot_keys, one_per, probe, unit_starts, whole_units, with_blocks

TOKEN = "[a-z0-9]+"
WORDS = 8  # words of 16 bits in a code
STEP = 1 << 18  # pairs that a walk makes at a time
PORTION = 3_000_000  # bytes of n-gram sets that are unpacked at a time


def token_count(text: F.Column) -> F.Column:
    """Number of tokens (maximal runs of a-z and 0-9) of the lower-cased text."""
    return F.regexp_count(F.lower(text), F.lit(TOKEN))


def pack(values: np.ndarray) -> bytes:
    """24-bit numbers as three bytes each."""
    return values.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values one after another, and how many each has."""
    size = np.array([len(x) // 3 for x in packed], np.int64)
    four = np.zeros((size.sum(), 4), np.uint8)
    four[:, :3] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 3)
    return four.view("<u4").ravel(), size


def portions(size: np.ndarray, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """Row ranges [begin, end) whose sizes add up to at most ``most``; a larger row stands alone."""
    total, begin = np.cumsum(size), 0
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end


def sliced(batches: Iterator[pa.RecordBatch], sets: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the n-gram sets in these columns stay within a portion."""
    for batch in batches:
        size = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in sets)
        for begin, end in portions(size):
            yield batch.slice(begin, end - begin)


def ngram_sets(rows: DataFrame, text: str, n: int, min_tokens: int) -> DataFrame:
    """``(class, grams)`` per distinct text of at least ``min_tokens`` tokens.

    ``grams`` holds the sorted distinct n-gram hashes, three bytes each.  Null texts and
    texts with fewer tokens have no row.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TOKEN).findall
        seen: dict[str, int] = {}
        mix = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
        for batch in batches:
            classes, sets = [], []
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = find(t.lower())
                if len(tokens) < max(min_tokens, n):
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                for w in tokens:
                    if w not in seen:
                        seen[w] = xxhash.xxh64_intdigest(w)
                h = np.array([seen[w] for w in tokens], np.uint64)
                g = np.zeros(len(h) - n + 1, np.uint64)
                for i in range(n):
                    g = (g ^ h[i : len(h) - n + 1 + i]) * mix[i % 4]
                    g ^= g >> np.uint64(29)
                classes.append(c)
                sets.append(pack(np.unique((g >> np.uint64(40)).astype("<u4"))))
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], ["class", "grams"])

    texts = rows.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("class"), F.col(text).alias("text"))
    return one_per(texts.mapInArrow(grams, "class long, grams binary"), "class")


def trie_rows(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(key, class, code)`` per class and trie: the trie's top and the code below it."""
    hashes = WORDS * 8
    assert bands * rows <= hashes
    rng = np.random.default_rng(20240607)
    odd = rng.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 2**63, hashes, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, (1,)):
            values, size = unpack(batch.column(1).to_pylist())
            begins = np.cumsum(size) - size
            grams = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            low = np.empty((len(size), hashes), np.uint32)
            for k in range(hashes):
                h = (grams ^ flip[k]) * odd[k]
                low[:, k] = np.minimum.reduceat((h >> np.uint64(32)).astype(np.uint32), begins)
            two = ((low[:, :, None] >> np.arange(2, dtype=np.uint32)) & 1).reshape(len(size), -1)
            code = np.packbits(two.astype(np.uint8), axis=1)
            classes = batch.column(0).to_numpy()
            keys = np.empty((bands, len(size)), np.uint64)
            for b in range(bands):
                key = np.full(len(size), b + 1, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                for k in range(b * rows, b * rows + rows):
                    key = (key ^ low[:, k].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
                    key ^= key >> np.uint64(31)
                keys[b] = key
            for b in range(bands):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[b].astype(np.int64)), pa.array(classes), binary_rows(code)], ["key", "class", "code"]
                )

    return sets.mapInArrow(sketch, "key long, class long, code binary")


def trie_walk(
    group: np.ndarray, words: np.ndarray, budget: int, roots: tuple[np.ndarray, np.ndarray] | None = None, step: int = STEP
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs i < j whose codes differ in at most ``budget`` bits, a part at a time.

    ``group`` numbers the tries' tops, ``words`` (n x w, 16-bit) are the codes;
    rows are sorted by group, then code.  ``roots`` are the pairs of groups to
    compare, the lesser first (each with itself by default).  The tries are
    walked one word per step: each step replaces a pair of nodes by the pairs of
    their children and prunes by the differing bits so far.  Two nodes of one row
    each are compared at once.  At most ``step`` pairs of children are made
    before the walk goes down, so a hot group takes no more memory than a small one.
    """
    n, depth = words.shape
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    nodes = [np.flatnonzero(new)]  # of each depth, as first rows; below the last word come the rows
    for d in range(depth):
        new[1:] |= words[1:, d] != words[:-1, d]
        nodes.append(np.flatnonzero(new))
    nodes.append(np.arange(n))
    first = [np.searchsorted(c, p) for p, c in zip(nodes, nodes[1:])]
    count = [np.diff(np.append(f, len(c))) for f, c in zip(first, nodes[1:])]
    alone = [np.diff(np.append(x, n)) == 1 for x in nodes]
    whole = np.zeros((n, -(-depth // 4) * 4), np.uint16)
    whole[:, :depth] = words
    whole = [np.ascontiguousarray(x) for x in whole.view(np.uint64).T]

    def children(d, a, b, errors, many, ends, low, high):
        """Of the pairs of children numbered from low to high: row pairs that are done, and what is left to walk."""
        s, e = np.searchsorted(ends, (low, high - 1), "right")
        e += 1
        at = np.repeat(np.arange(s, e), np.minimum(ends[s:e], high) - np.maximum(ends[s:e] - many[s:e], low))
        x, y = np.divmod(np.arange(low, high) - (ends[at] - many[at]), count[d][b[at]])
        i, j = first[d][a[at]] + x, first[d][b[at]] + y
        if d == depth:
            keep = i < j
            return (i[keep], j[keep]), None
        child = nodes[d + 1]
        spent = errors[at] + np.bitwise_count(words[child[i], d] ^ words[child[j], d])
        keep = (i <= j) & (spent <= budget)
        i, j, spent = i[keep], j[keep], spent[keep]
        one = alone[d + 1][i] & alone[d + 1][j]
        x, y = child[i[one]], child[j[one]]
        near = (x < y) & (sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int16) for w in whole) <= budget)
        return (x[near], y[near]), (i[~one], j[~one], spent[~one])

    def walk(d, a, b, errors):
        many = count[d][a] * count[d][b]
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        for low in range(0, total, step):
            done, rest = children(d, a, b, errors, many, ends, low, min(low + step, total))
            if len(done[0]):
                yield done
            if rest and len(rest[0]):
                yield from walk(d + 1, *rest)

    a, b = (np.arange(len(nodes[0])),) * 2 if roots is None else roots
    yield from walk(0, a, b, np.zeros(len(a), np.int16))


def trie_self_join(group: np.ndarray, words: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one group whose codes differ in at most ``budget`` bits, as ``trie_walk`` finds them."""
    parts = list(trie_walk(group, words, budget)) or [(np.zeros(0, np.int64),) * 2]
    i, j = (np.concatenate(x) for x in zip(*parts))
    return i, j


def class_pairs(parts: Iterator[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, step: int = STEP) -> Iterator[pa.RecordBatch]:
    """``(class_a, class_b)`` of row pairs, about ``step`` pairs a batch; a batch holds no pair twice."""

    def batch() -> pa.RecordBatch:
        x, y = (classes[np.concatenate(side)] for side in zip(*held))
        a, b = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["class_a", "class_b"])

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= step:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def trie_pairs(rows: DataFrame, budget: int, block: int, hot: DataFrame | None = None) -> DataFrame:
    """Candidate pairs ``(class_a, class_b)`` that share a trie within the budget; ``hot`` as in ``blocks.bucket_units``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_units(batches, "key"):
            starts = unit_starts(part, "key")
            unit = np.zeros(part.num_rows, np.int64)
            unit[starts] = 1
            unit = np.cumsum(unit)
            words = fixed_bytes(part.column("code"), WORDS * 2).copy().view(">u2").astype(np.uint16)
            u, v, blk = (part.column(c).to_numpy() for c in ("u", "v", "blk"))
            group = 2 * unit + (blk != u)  # the blocks of a unit are tries of their own
            order = np.lexsort((*words.T[::-1], group))
            group = group[order]
            tops = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
            own = np.flatnonzero((u == v)[order][tops])
            two = np.flatnonzero(np.diff(group[tops] // 2) == 0)
            roots = np.concatenate((own, two)), np.concatenate((own, two + 1))
            yield from class_pairs(trie_walk(group, words[order], budget, roots), part.column("class").to_numpy()[order])

    units = bucket_units(rows, "key", "class", block, hot)
    return units.mapInArrow(join, "class_a long, class_b long").distinct()


def exact_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(class_a, class_b, jaccard)`` of the pairs that reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, (2, 3)):
            sides, sizes = [], []
            for c in (2, 3):
                values, size = unpack(batch.column(c).to_pylist())
                row = np.repeat(np.arange(len(size), dtype=np.uint64), size) << np.uint64(32)
                sides.append(row | values)
                sizes.append(size)
            both = np.sort(np.concatenate(sides))
            same = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
            shared = np.bincount(same.astype(np.int64), minlength=batch.num_rows)
            jaccard = shared / (sizes[0] + sizes[1] - shared)
            keep = np.flatnonzero(jaccard >= threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(jaccard[keep])],
                ["class_a", "class_b", "jaccard"],
            )

    a = sets.select(F.col("class").alias("class_a"), F.col("grams").alias("grams_a"))
    b = sets.select(F.col("class").alias("class_b"), F.col("grams").alias("grams_b"))
    joined = pairs.join(a.hint("merge"), "class_a").join(b.hint("merge"), "class_b").select("class_a", "class_b", "grams_a", "grams_b")
    return joined.mapInArrow(check, "class_a long, class_b long, jaccard double")


def similar_classes(
    rows: DataFrame,
    text: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    min_tokens: int = 5,
    bands: int = 16,
    band_rows: int = 3,
    block: int = 4096,
) -> DataFrame:
    """Pairs of different texts whose n-gram sets reach the threshold.

    Returns ``(class_a, class_b, jaccard)`` with class_a < class_b as numbers.
    The Hamming budget is the expected number of differing bits at the
    threshold plus three standard deviations.
    """
    minhashes = WORDS * 8
    mean = minhashes * (1 - threshold)
    budget = int(mean + 3 * np.sqrt(minhashes * ((1 - threshold) * 1.5 - (1 - threshold) ** 2)) + 0.5)
    sets = ngram_sets(rows, text, n, min_tokens)
    hot = hot_keys(trie_rows(probe(sets, "grams"), bands, band_rows), "key", 1 / (512 * bands), PROBED)
    candidates = trie_pairs(trie_rows(sets, bands, band_rows), budget, block, hot)
    return exact_pairs(candidates, sets, threshold)


def members(rows: DataFrame, key: str, text: str, min_tokens: int) -> DataFrame:
    """``(id, class)`` once per key; rows with a null key or too short a text have none."""
    return (
        rows.filter(F.col(key).isNotNull() & (token_count(F.col(text)) >= min_tokens))
        .select(F.col(key).alias("id"), F.xxhash64(text).alias("class"))
        .distinct()
    )


def similar_pairs(rows: DataFrame, key: str, text: str = "text", n: int = 5, threshold: float = 0.8, min_tokens: int = 5) -> DataFrame:
    """All pairs ``(id_a, id_b)`` of different keys with similar texts, id_a < id_b.

    Repeated rows count once.  Null keys, null texts and texts with fewer than
    ``min_tokens`` tokens take no part; an empty table gives no pair.  Extra
    columns are ignored.  The output holds every pair of exact copies, which is
    what its definition asks for; ``similar_groups`` is the compact form.
    """
    ids = members(rows, key, text, max(n, min_tokens))
    links = similar_classes(rows, text, n, threshold, min_tokens).select("class_a", "class_b")
    across = linked_members(links, ids)
    found = across.filter(F.col("x") != F.col("y")).unionByName(copies(ids))
    return found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def linked_members(links: DataFrame, ids: DataFrame, limit: int = 4096) -> DataFrame:
    """``(x, y)``: the members of linked classes.  Members of a hot class are spread over blocks, and its links go to each."""
    hot = hot_keys(ids, "class")
    placed = with_blocks(ids, hot, "class", "id", limit).select("id", "class", "blk")
    for side in ("class_a", "class_b"):
        marked = links.join(F.broadcast(hot), F.col(side) == F.col("hot"), "left")  # bounded, see hot_keys
        last = F.when(F.col("n") > limit, F.ceil(F.col("n") / limit).cast("int") - 1).otherwise(0)
        links = marked.withColumn(f"{side}_blk", F.explode(F.sequence(F.lit(0), last))).drop("hot", "n")
    for side, name in (("class_a", "x"), ("class_b", "y")):
        own = placed.select(F.col("id").alias(name), F.col("class").alias(side), F.col("blk").alias(f"{side}_blk"))
        links = links.join(own, [side, f"{side}_blk"])
    return links.select("x", "y")


def copies(ids: DataFrame, limit: int = 2048) -> DataFrame:
    """``(x, y)``: every two members of one class, a block of members against a block at a time."""
    units = bucket_units(ids.select("class", "id"), "class", "id", limit)
    unit = ["class", "u", "v"]
    left = units.filter(F.col("blk") == F.col("u")).select(*unit, F.col("id").alias("x"))
    right = units.filter(F.col("blk") == F.col("v")).select(*unit, F.col("id").alias("y"))
    return left.join(right, unit).filter((F.col("u") != F.col("v")) | (F.col("x") < F.col("y"))).select("x", "y")
