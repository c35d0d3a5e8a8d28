"""Registered queries of the training-data operators.

Every query reads its whole tables; the production parameters stand here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import encode, groups, leakage, near_dup, pairs, pii, splitting, vectors
from quarrylight.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of similarity 0.85 or more of which one is among the other's 10 nearest."""
    near = vectors.nearest_vectors(table(spark, sf_dir, "chunk_vectors"), k=10, min_similarity=0.85)
    return near.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors, in order, of each vector, however similar."""
    near = vectors.nearest_vectors(table(spark, sf_dir, "chunk_vectors"), k=10, exhaustive=True)
    return near.select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour_id"), "rank", F.round("similarity", 6).alias("similarity"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose 3-token sets have a Jaccard similarity of 0.6 or more."""
    pairs = near_dup.similar_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "text", n=3, threshold=0.6, min_tokens=20)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each chunk and the number of its near-duplicates."""
    found = groups.similar_groups(table(spark, sf_dir, "chunks"), "chunk_id", "text", n=3, threshold=0.6, min_tokens=20)
    return found.select(F.col("id").alias("chunk_id"), "group_id", "links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that claim an answer and have a defect."""
    profile = pairs.learn(table(spark, sf_dir, "documents"))
    return pairs.defective_pairs(table(spark, sf_dir, "eval_samples"), profile).select(F.col("id").alias("sample_id"), "defect")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks longer than their filing's size, and whether a cut had to be forced."""
    cut = splitting.split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "ingest_documents"))
    forced = F.exists("pieces", lambda p: p["forced"])
    return cut.select(F.col("key").alias("chunk_id"), F.when(forced, "forced").otherwise("natural").alias("cut"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of those chunks in order."""
    cut = splitting.split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "ingest_documents"))
    each = cut.select("key", F.posexplode("pieces").alias("piece_no", "p"))
    return each.select(F.col("key").alias("chunk_id"), "piece_no", F.col("p.start").alias("start_pos"), F.col("p.piece").alias("piece"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode.encode(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "ids")


def p6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of tokens and whether decoding gives back the text."""
    docs = table(spark, sf_dir, "documents")
    ids = encode.encode(docs)
    back = encode.decode(ids, "id", "ids").select("id", F.sha2("bytes", 256).alias("digest"))
    size = ids.select("id", F.size("ids").alias("n_tokens"))
    text = docs.select(F.col("doc_id").alias("id"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("stored"))
    joined = size.join(back, "id").join(text, "id")
    return joined.select(F.col("id").alias("doc_id"), "n_tokens", (F.col("digest") == F.col("stored")).alias("same"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [F.array("question"), F.transform("evidence", lambda e: e["evidence_text"])]
    return leakage.leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "questions"), "doc_id", "text", "financebench_id", texts, run=12
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a run of 12 tokens of a question or of its evidence."""
    return _leaks(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("test").alias("financebench_id")).distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token spans to remove, with the test items leaked into each."""
    return _leaks(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("test").alias("financebench_id"), "first_token", "last_token")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of personal information."""
    spans = pii.personal_spans(table(spark, sf_dir, "documents"))
    return spans.select(F.col("id").alias("doc_id"), "kind", F.col("start").alias("start_pos"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with typed placeholders in place of personal information."""
    return pii.redact(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_groups, p4_found, p5_found, p5_pieces, p6_ids, p6_tokens, p7_found, p7_spans, p8_found, p8_redacted)}
