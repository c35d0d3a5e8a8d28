"""Encoding of whole texts with a public byte-level BPE tokenizer.

Method: overlapping chunk encoding.  A text is cut into chunks that overlap, so
that the chunks of one text are encoded in parallel; a text of one chunk has no
neighbours and is encoded where it is read.  Each chunk is pre-tokenised on its
own.  Pre-tokenisation runs from left to right and looks ahead by one character
only, so once two neighbouring chunks have a pre-token boundary in common
inside their overlap, they agree from there on: the text is cut at that
boundary, where no token spans it, and the pieces are encoded apart.  A chunk
travels with its predecessor, so its task finds both of its cuts and no text is
moved twice.  Where no boundary resynchronises inside an overlap (one run
longer than the overlap) the pieces on both sides stay text and are joined
before they are encoded.  Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(folder: str, vocabulary: str) -> tiktoken.Encoding:
    """The tokenizer, read once per worker."""
    with open(os.path.join(folder, vocabulary), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str) -> list[int]:
    """Start positions of the pre-tokens."""
    return [m.start() for m in regex.finditer(PATTERN, text)]


def resynchronised(left: str, right: str, offset: int) -> int | None:
    """Where two overlapping chunks agree, as a position in ``left``, or None.

    ``right`` begins at ``offset`` of ``left``.  The last pre-token of ``left``
    may continue beyond its end, so boundaries need a pre-token after them.  A
    boundary after white space is passed over: what a run of white space breaks
    into depends on what follows it.
    """
    tail = left[offset:]
    ours = [b - offset for b in boundaries(left)[:-1] if b >= offset]
    theirs = set(boundaries(right[: len(tail)])[:-1])
    return next((offset + b for b in ours if b in theirs and b > 0 and not tail[b - 1].isspace()), None)


def id_arrays(texts: list[str], encoder: tiktoken.Encoding) -> pa.Array:
    """Token ids of each text as a list column."""
    parts = [encoder.encode_to_numpy(t, disallowed_special=()) if t else np.zeros(0, np.uint32) for t in texts]
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def encode(
    rows: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    folder: str = FOLDER,
    vocabulary: str = VOCABULARY,
    chunk: int = 4096,
    overlap: int = 512,
) -> DataFrame:
    """``(id, ids)``: the token ids of every row's text, without special tokens.

    Null and empty texts give an empty list; blanks and all other characters
    are encoded as stored; strings that look like special tokens are ordinary
    text.  One result row per input row, repeats included; a null key is kept.
    The work is linear in the length of a text.
    """
    kind = rows.schema[key].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(folder, vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), id_arrays(texts, encoder)], ["id", "ids"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every chunk behind its predecessor and before its overlap, some 2 MB of text at a time."""
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count = -(-len(t) // chunk)
                for first in range(0, count, 256):
                    numbers = range(first, min(first + 256, count))
                    held = [t[max(0, i - 1) * chunk : (i + 1) * chunk + overlap] for i in numbers]
                    last = [(i + 1) * chunk >= len(t) for i in numbers]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(held), pa.int64()), pa.array(numbers, pa.int32()), pa.array(held), pa.array(last)], ["row", "i", "held", "last"]
                    )

    def cut(left: str, right: str) -> int | None:
        """Where the chunk ``right`` takes over from ``left`` (both with their overlaps), as a position in ``right``."""
        at = resynchronised(left, right[:overlap], chunk)
        return None if at is None else at - chunk

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's part of the text, encoded, or as text if a cut of it is missing."""
        encoder = encoding(folder, vocabulary)
        for batch in batches:
            parts, raw = [], []
            for i, held, last in zip(*(batch.column(c).to_pylist() for c in ("i", "held", "last"))):
                own = held[chunk:] if i else held
                start = cut(held[: chunk + overlap], own) if i else 0
                end = None
                if not last:
                    after = cut(own, own[chunk:])
                    end = chunk if after is None else chunk + after
                whole_ = start is not None and (last or after is not None)
                parts.append(own[start or 0 : end])
                raw.append(not whole_)
            ids = id_arrays(["" if r else p for p, r in zip(parts, raw)], encoder)
            texts = pa.array([p if r else None for p, r in zip(parts, raw)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("i"), ids, texts], ["row", "i", "ids", "raw"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of a text in order, neighbouring parts that are still text encoded as one."""
        encoder = encoding(folder, vocabulary)
        for batch in batches:
            for row, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
                order, ids, raw = (parts.values.field(c) for c in range(3))
                out, text_ = [], []
                for p, t in enumerate(raw.to_pylist()):
                    if t is not None:
                        text_.append(t)
                        continue
                    if text_:
                        out.append(id_arrays(["".join(text_)], encoder).values)
                        text_ = []
                    out.append(ids[p].values)
                if text_:
                    out.append(id_arrays(["".join(text_)], encoder).values)
                merged = pa.concat_arrays(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(merged)], pa.int32()), merged)], ["row", "ids"]
                )

    source = rows.select(F.col(key).alias("id"), F.col(text).alias("text"))
    size = F.length("text")
    short = source.filter(F.coalesce(size <= chunk, F.lit(True)))
    direct = short.mapInArrow(whole, f"id {kind}, ids array<int>")

    # the row id is the key and the text's own hash: the same in every re-run of a task
    long_ = source.filter(size > chunk).withColumn("row", F.xxhash64("id", "text"))
    spread = long_.select("row", "text").mapInArrow(chunks, "row long, i int, held string, last boolean").dropDuplicates(["row", "i"])
    parts = spread.mapInArrow(pieces, "row long, i int, ids array<int>, raw string")
    listed = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "ids", "raw"))).alias("parts"))
    encoded = listed.mapInArrow(joined, "row long, ids array<int>")
    stitched = long_.select("id", "row").join(encoded, "row").select("id", "ids")
    return direct.unionByName(stitched)


def decode(rows: DataFrame, key: str, ids: str, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, bytes)``: the tokens' raw bytes one after another; null ids give null."""
    kind = rows.schema[key].dataType.simpleString()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(folder, vocabulary)
        for batch in batches:
            out = [None if x is None else encoder.decode_bytes(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    return rows.select(F.col(key).alias("id"), F.col(ids).alias("ids")).mapInArrow(back, f"id {kind}, bytes binary")
