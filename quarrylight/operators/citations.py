"""Citation markers, coverage and validity of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T


def resolved(marker: Column, citations: Column) -> Column:
    """The 1-based place of the citation that a marker names, or null.

    Digits are a place; anything else is a chunk id compared without case, the
    first such citation counting.
    """
    bare = T.bare_marker(marker)
    ids = F.transform(citations, lambda c: F.lower(c["chunk_id"]))
    place = F.when(bare.rlike("^[0-9]{1,9}$"), bare.cast("int"))
    by_place = F.when((place >= 1) & (place <= F.size(citations)), place)
    by_id = F.nullif(F.array_position(ids, F.lower(bare)).cast("int"), F.lit(0))
    return F.when(place.isNotNull(), by_place).otherwise(F.when(bare != "", by_id))


def claims(answers: DataFrame) -> DataFrame:
    """``(sample_id, pos, sentence, covered)``: the sentences that need a citation.

    Those with a digit, or all where none has one; covered if any marker in
    them resolves.  ``answers`` has ``sample_id, answer, citations``.
    """
    parts = T.sentences(F.col("answer"))
    numeric = F.filter(parts, lambda s: s.rlike("[0-9]"))
    chosen = F.when(F.size(numeric) > 0, numeric).otherwise(parts)
    each = answers.select("sample_id", "citations", F.posexplode(chosen).alias("pos", "sentence"))
    places = F.transform(T.markers(F.col("sentence")), lambda m: resolved(m, F.col("citations")))
    return each.select("sample_id", "pos", "sentence", F.exists(places, lambda p: p.isNotNull()).alias("covered"))


def coverage(answers: DataFrame) -> DataFrame:
    """``(sample_id, coverage)``: share of claims that are covered; no sentence gives 0."""
    shares = claims(answers).groupBy("sample_id").agg(F.avg(F.col("covered").cast("double")).alias("share"))
    return answers.select("sample_id").join(shares, "sample_id", "left").select("sample_id", F.coalesce("share", F.lit(0.0)).alias("coverage"))


def cited(answers: DataFrame) -> DataFrame:
    """Distinct citations that each answer's markers name, with their page keys."""
    each = answers.select("*", F.explode(T.markers(F.col("answer"))).alias("marker"))
    placed = each.withColumn("place", resolved(F.col("marker"), F.col("citations"))).filter(F.col("place").isNotNull())
    named = placed.dropDuplicates(["sample_id", "place"]).withColumn("c", F.element_at("citations", F.col("place")))
    return named.dropDuplicates(["sample_id", "c"])


def validity(answers: DataFrame) -> DataFrame:
    """``(sample_id, validity)``: share of the cited evidence that exists and is gold.

    ``answers`` has ``sample_id, answer, citations, retrieved_chunk_ids,
    gold_doc_keys, gold_page_keys, chunk_key_index``.  A citation outside the
    retrieved ids, the gold documents or the gold pages is invalid (each test
    only where the list is not empty); no citation gives 0.  The page key of a
    citation comes from the index, else its document from the chunk id, else
    from the filing.
    """
    c = F.col("c")
    mapped = F.coalesce(F.try_element_at("chunk_key_index", c["chunk_id"]), F.lit(""))
    by_id = F.nullif(T.doc_key_of_chunk(F.coalesce(c["chunk_id"], F.lit(""))), F.lit(""))
    doc = F.when(mapped != "", F.split_part(mapped, F.lit("#p"), F.lit(1))).otherwise(F.coalesce(by_id, T.doc_key(c["filing"])))
    page = F.when(mapped != "", F.split_part(mapped, F.lit("#p"), F.lit(2))).otherwise(F.coalesce(c["page"].cast("string"), F.lit("?")))
    known = F.filter("retrieved_chunk_ids", lambda x: x != "")
    own_id = F.coalesce(c["chunk_id"], F.lit("")) != ""
    unknown = own_id & (F.size(known) > 0) & ~F.array_contains(known, c["chunk_id"])
    wrong_doc = (F.size("gold_doc_keys") > 0) & (doc != "") & ~F.array_contains("gold_doc_keys", doc)
    key = F.concat(doc, F.lit("#p"), F.when(page == "", "?").otherwise(page))
    wrong_page = (F.size("gold_page_keys") > 0) & ~F.array_contains("gold_page_keys", key)
    bad = F.coalesce(unknown, F.lit(False)) | F.coalesce(wrong_doc, F.lit(False)) | F.coalesce(wrong_page, F.lit(False))
    shares = cited(answers).groupBy("sample_id").agg(F.avg((~bad).cast("double")).alias("share"))
    return answers.select("sample_id").join(shares, "sample_id", "left").select("sample_id", F.coalesce("share", F.lit(0.0)).alias("validity"))
