"""Evaluation passages inside a corpus, by an FM-index per training shard.

``build_index`` turns the documents that each task reads into shards of bounded
size and gives one row per shard: a shard is the sequence of its documents'
tokens, each document closed by a separator and the shard by a terminator.
Tokens are numbered by the shard's own vocabulary, so the index does not depend
on any test material and can be kept.  From the suffix array come the
Burrows-Wheeler transform, held in a wavelet matrix, and suffix positions
sampled at every ``STEP``-th place.  A document longer than a shard is cut into
segments that overlap by one phrase less a token, so no occurrence is lost or
found twice.

``leaks`` searches all test phrases of ``run`` tokens backwards at once; the
occurrences are located by walking to the next sampled position, and runs of
neighbouring occurrences are merged to spans.  The corpus is read once and not
shuffled.  Phrases go to the shards in blocks of at most ``MAX_PHRASES``
distinct ones, as numbers into the block's own vocabulary; with several blocks
the index is written first and searched by each of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.session import materialise

TOKEN = "[a-z0-9]+"
SHARD = 1_500_000  # tokens per shard
STEP = 8  # every so many positions one is sampled
MAX_PHRASES = 500_000  # distinct phrases broadcast at once (24 MB at 12 tokens)
TERMINATOR, SEPARATOR, FIRST = 0, 1, 2  # symbols; words are numbered from FIRST


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling over what is still tied.

    ``text`` ends with its only terminator.  The first key packs as many
    symbols as fit into 64 bits.
    """
    n = len(text)
    width = int(text.max() + 1).bit_length()
    length = min(4, 64 // width)
    padded = np.concatenate((text + 1, np.zeros(length, text.dtype))).astype(np.uint64)  # beyond the end: below all symbols
    key = np.zeros(n, np.uint64)
    for i in range(length):
        key = (key << np.uint64(width)) | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    rank = np.empty(n, np.int64)
    rank[order] = first
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of several
    while len(tied):
        suffix = order[tied]
        after = suffix + length
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1) + 1
        key = (rank[suffix].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(key, kind="stable")
        order[tied] = suffix[by]
        ranked = key[by]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        length *= 2
    return order


class WaveletMatrix:
    """Rank and access over a sequence of numbers, vectorised over queries."""

    def __init__(self, words: np.ndarray, n: int):
        """``words`` holds the bits of each level, the highest first, 64 to a word."""
        self.bits, self.n, self.words = len(words), n, words
        counts = np.bitwise_count(words)
        self.before = np.concatenate((np.zeros((len(words), 1), np.int64), np.cumsum(counts, axis=1, dtype=np.int64)), axis=1)
        self.zeros = n - self.before[:, -1]

    @classmethod
    def of(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        n, levels = len(values), []
        for level in range(bits - 1, -1, -1):
            ones = ((values >> level) & 1).astype(bool)
            levels.append(np.packbits(np.pad(ones, (0, -n % 64 + 64)), bitorder="little").view(np.uint64))
            values = np.concatenate((values[~ones], values[ones]))
        return cls(np.stack(levels), n)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each place of one level."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        start, end = np.zeros_like(at), at.copy()
        for level in range(self.bits):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            s1, e1 = self._ones(level, start), self._ones(level, end)
            start = np.where(bit, self.zeros[level] + s1, start - s1)
            end = np.where(bit, self.zeros[level] + e1, end - e1)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its occurrences before the place."""
        symbol, start, end = np.zeros_like(at), np.zeros_like(at), at.copy()
        for level in range(self.bits):
            bit = ((self.words[level][end >> 6] >> (end & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            s1, e1 = self._ones(level, start), self._ones(level, end)
            start = np.where(bit, self.zeros[level] + s1, start - s1)
            end = np.where(bit, self.zeros[level] + e1, end - e1)
            symbol = (symbol << 1) | bit
        return symbol, end - start


class FMIndex:
    """Backward search and location over one shard."""

    def __init__(self, bwt: WaveletMatrix, smaller: np.ndarray, kept: np.ndarray, position: np.ndarray):
        self.bwt, self.smaller, self.kept, self.position = bwt, smaller, kept, position
        self.sampled = np.concatenate(([0], np.cumsum(kept)))

    @classmethod
    def of(cls, text: np.ndarray, symbols: int) -> FMIndex:
        """The index of a sequence of symbols that ends with its only terminator."""
        order = suffix_array(text)
        bwt = WaveletMatrix.of(text[order - 1].astype(np.int64), max(1, int(symbols - 1).bit_length()))
        smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        kept = order % STEP == 0
        return cls(bwt, smaller, kept, order[kept])

    def to_bytes(self) -> bytes:
        """The index in one value: sizes, bits of the levels, symbol counts, sampled places and positions."""
        head = np.array([self.bwt.n, self.bwt.bits, self.bwt.words.shape[1], len(self.smaller), len(self.position)], np.int64)
        parts = (head, self.bwt.words, self.smaller.astype(np.int64), self.position.astype(np.int64), np.packbits(self.kept))
        return b"".join(x.tobytes() for x in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> FMIndex:
        n, bits, width, symbols, positions = np.frombuffer(data, np.int64, 5).tolist()
        at = 40
        words = np.frombuffer(data, np.uint64, bits * width, at).reshape(bits, width)
        at += words.nbytes
        smaller = np.frombuffer(data, np.int64, symbols, at)
        position = np.frombuffer(data, np.int64, positions, at + smaller.nbytes)
        kept = np.unpackbits(np.frombuffer(data, np.uint8, offset=at + smaller.nbytes + position.nbytes))[:n].astype(bool)
        return cls(WaveletMatrix(words, n), smaller, kept, position)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(phrase, low, high)`` of the phrases (rows) that occur."""
        last = phrases[:, -1]
        low, high = self.smaller[last], self.smaller[last + 1]
        live = np.flatnonzero(high > low)
        low, high = low[live], high[live]
        for column in range(phrases.shape[1] - 2, -1, -1):
            symbol = phrases[live, column]
            low = self.smaller[symbol] + self.bwt.rank(symbol, low)
            high = self.smaller[symbol] + self.bwt.rank(symbol, high)
            some = high > low
            live, low, high = live[some], low[some], high[some]
            if len(live) == 0:
                break
        return live, low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(range, position)`` of every row of the ranges."""
        count = high - low
        owner = np.repeat(np.arange(len(low)), count)
        row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[owner]
        found, steps = np.full(len(row), -1, np.int64), 0
        open_ = np.arange(len(row))
        while len(open_):
            at = row[open_]
            done = self.kept[at]
            found[open_[done]] = self.position[self.sampled[at[done]]] + steps
            open_ = open_[~done]
            symbol, before = self.bwt.access(row[open_])
            row[open_] = self.smaller[symbol] + before
            steps += 1
        return owner, found


def test_phrases(tests: DataFrame, key: str, texts: list[F.Column], run: int) -> DataFrame:
    """``(test, phrase)``: each test's distinct phrases of ``run`` tokens, every text by itself."""
    each = tests.filter(F.col(key).isNotNull()).select(F.col(key).alias("test"), F.explode(F.concat(*texts)).alias("text"))
    tokens = each.select("test", F.regexp_extract_all(F.lower("text"), F.lit(f"({TOKEN})"), F.lit(1)).alias("tokens"))
    long_enough = tokens.filter(F.size("tokens") >= run)
    starts = F.sequence(F.lit(1), F.size("tokens") - (run - 1))
    return long_enough.select("test", F.explode(F.transform(starts, lambda i: F.slice("tokens", i, run))).alias("phrase")).distinct()


def build_index(corpus: DataFrame, key: str, text: str, run: int, shard: int = SHARD) -> DataFrame:
    """``(ids, begins, offsets, words, data)``: one row per shard of the corpus.

    Segment i of a shard begins at symbol ``begins[i]`` and at token
    ``offsets[i]`` of the document ``ids[i]``; ``words`` is the shard's
    vocabulary in the order of its symbols.  Texts of fewer than ``run`` tokens
    have no segment.
    """
    kind = corpus.schema[key].dataType.simpleString()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TOKEN).findall
        ids, offsets, parts, size, codes = [], [], [], 0, {}

        def row() -> pa.RecordBatch:
            begins = np.cumsum([0] + [len(p) for p in parts[:-1]])
            index = FMIndex.of(np.concatenate([*parts, [TERMINATOR]]), len(codes) + FIRST)
            held = pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), pa.concat_arrays(ids))
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (begins, offsets)]
            return pa.RecordBatch.from_arrays(
                [held, *lists, pa.array([list(codes)], pa.list_(pa.string())), pa.array([index.to_bytes()], pa.binary())],
                ["ids", "begins", "offsets", "words", "data"],
            )

        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                tokens = find(t.lower())
                for start in range(0, len(tokens) - run + 1, shard - run + 1):
                    piece = tokens[start : start + shard]
                    if size and size + len(piece) > shard:
                        yield row()
                        ids, offsets, parts, size, codes = [], [], [], 0, {}
                    for w in piece:
                        if w not in codes:
                            codes[w] = len(codes) + FIRST
                    numbers = np.fromiter((codes[w] for w in piece), np.int64, len(piece))
                    ids.append(batch.column(0).slice(i, 1))
                    offsets.append(start)
                    parts.append(np.append(numbers, SEPARATOR))
                    size += len(piece) + 1
        if parts:
            yield row()

    source = corpus.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(shards, f"ids array<{kind}>, begins array<bigint>, offsets array<bigint>, words array<string>, data binary")


def search_block(spark, block: int, phrases: pa.Table, run: int):
    """The task that searches a block of phrases in every shard it reads."""
    flat = pc.dictionary_encode(pa.concat_arrays([c.flatten() for c in phrases.column("phrase").chunks]))
    shared = spark.sparkContext.broadcast((flat.dictionary, flat.indices.to_numpy().reshape(-1, run)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, matrix = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                ids, begins, offsets, words = (batch.column(c)[r].values for c in range(4))
                code = pc.index_in(vocabulary, words).fill_null(-FIRST - 1).to_numpy(zero_copy_only=False).astype(np.int64) + FIRST
                phrase = code[matrix]
                known = np.flatnonzero((phrase >= 0).all(1))  # the others have a word that the shard lacks
                if len(known) == 0:
                    continue
                index = FMIndex.from_bytes(batch.column(4)[r].as_py())
                hit, low, high = index.search(phrase[known])
                which, at = index.locate(low, high)
                begin = begins.to_numpy()
                segment = np.searchsorted(begin, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(segment)),
                        pa.array(np.full(len(at), block, np.int32)),
                        pa.array(known[hit[which]].astype(np.int32)),
                        pa.array(at - begin[segment] + offsets.to_numpy()[segment]),
                    ],
                    ["id", "block", "no", "start"],
                )

    return search


def leaks(
    corpus: DataFrame,
    tests: DataFrame,
    corpus_key: str,
    corpus_text: str,
    test_key: str,
    test_texts: list[F.Column],
    run: int = 12,
    shard: int = SHARD,
    max_phrases: int = MAX_PHRASES,
) -> DataFrame:
    """``(id, test, first_token, last_token)``: spans of leaked test material.

    A span is a maximal union of overlapping or touching occurrences of the
    test's phrases of ``run`` tokens (numbered from 0, ends included).  Null
    and short texts on either side give nothing; ``test_texts`` are array
    columns of texts, each taken by itself, null arrays and elements ignored;
    repeated corpus rows give their spans once; null corpus keys give no row.
    Empty tables give no span; extra columns are ignored.
    """
    spark = corpus.sparkSession
    kind = corpus.schema[corpus_key].dataType.simpleString()
    filled = [F.filter(F.coalesce(t, F.expr("CAST(array() AS array<string>)")), lambda x: x.isNotNull()) for t in test_texts]
    phrases = materialise(test_phrases(tests, test_key, filled, run), "phrases")
    distinct = phrases.select("phrase").distinct()
    blocks = max(1, -(-distinct.count() // max_phrases))
    # numbered inside blocks, so that a hit is two small numbers
    placed = distinct.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)).cast("int"))
    numbered = materialise(placed.withColumn("no", F.row_number().over(W.partitionBy("block").orderBy("phrase")) - 1), "numbered")
    index = build_index(corpus, corpus_key, corpus_text, run, shard)
    if blocks > 1:
        index = materialise(index, "fm-index")
    hits = []
    for block in range(blocks):
        held = numbered.filter(F.col("block") == block).select("no", "phrase").toArrow().sort_by("no")
        if held.num_rows:
            hits.append(index.mapInArrow(search_block(spark, block, held, run), f"id {kind}, block int, no int, start bigint"))
    if not hits:
        return corpus.select(F.col(corpus_key).alias("id")).limit(0).join(phrases.select("test").limit(0)).selectExpr("id", "test", "0 AS first_token", "0 AS last_token")
    owners = numbered.join(phrases, "phrase").select("block", "no", "test")
    found = reduce(DataFrame.unionByName, hits).join(owners, ["block", "no"]).select("id", "test", "start").distinct()
    w = W.partitionBy("id", "test").orderBy("start")
    fresh = F.coalesce((F.col("start") > F.lag("start").over(w) + run).cast("int"), F.lit(1))
    spans = found.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(w))
    return (
        spans.groupBy("id", "test", "span")
        .agg(F.min("start").cast("int").alias("first_token"), (F.max("start") + (run - 1)).cast("int").alias("last_token"))
        .drop("span")
    )
