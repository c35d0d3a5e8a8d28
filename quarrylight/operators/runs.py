"""Evaluation runs as table operations: selection of questions, keys, judging and the second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as T

FAMILIES = ["retrieval", "citation", "ragas"]  # fixed values: families of metrics that a run can ask for
NO_TEXTS = "CAST(array() AS array<string>)"


def with_gold(questions: DataFrame, page_offset: int = 1) -> DataFrame:
    """Adds ``doc_keys`` and ``page_keys``: distinct gold keys in order.

    An evidence without a document name is of the question's document; pages
    are counted from 0 there and from 1 in keys; a null page has no key.
    """
    evidence = F.coalesce("evidence", F.expr("CAST(array() AS array<struct<doc_name:string,evidence_page_num:int,evidence_text:string>>)"))
    name = lambda e: F.coalesce(F.nullif(e["doc_name"], F.lit("")), F.col("doc_name"), F.lit(""))
    named = F.filter(evidence, lambda e: name(e) != "")
    keys = F.array_distinct(F.transform(named, lambda e: T.doc_key(name(e))))
    paged = F.filter(named, lambda e: e["evidence_page_num"].isNotNull())
    pages = F.array_distinct(F.transform(paged, lambda e: T.page_key(T.doc_key(name(e)), e["evidence_page_num"] + page_offset)))
    own = F.when(F.coalesce("doc_name", F.lit("")) != "", F.array(T.doc_key(F.col("doc_name")))).otherwise(F.expr(NO_TEXTS))
    return questions.withColumn("doc_keys", F.when(F.size(keys) > 0, keys).otherwise(own)).withColumn("page_keys", pages)


def filter_questions(questions: DataFrame, kind: str | None = None, companies: DataFrame | None = None, doc_keys: DataFrame | None = None) -> DataFrame:
    """The questions (``with_gold``) that can be graded: with gold documents, of a type, of companies, of documents.

    ``companies`` (``company``) are met without regard to case, the type
    exactly; of ``doc_keys`` (``key``) a question must have at least one.
    """
    kept = questions.filter(F.size("doc_keys") > 0)
    if kind is not None:
        kept = kept.filter(F.col("question_type") == kind)
    if companies is not None:
        names = companies.select(F.lower("company").alias("lc")).distinct()
        kept = kept.withColumn("lc", F.lower("company")).join(names, "lc", "left_semi").drop("lc")
    if doc_keys is not None:
        met = kept.select("financebench_id", F.explode("doc_keys").alias("key")).join(doc_keys.select("key").distinct(), "key", "left_semi")
        kept = kept.join(met.select("financebench_id").distinct(), "financebench_id", "left_semi")
    return kept


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``place``: the row's number from 0 in the order of a unique text column, without one global sort.

    Rows are numbered inside groups of a common beginning, and the groups'
    sizes are summed before them.
    """
    bucket = F.substring(order, 1, 6)
    sizes = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("bucket", before.alias("before"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy(order)) - 1
    return rows.withColumn("bucket", bucket).withColumn("within", place).join(starts, "bucket").withColumn("place", F.col("before") + F.col("within")).drop("bucket", "within", "before")


def question_key(own: Column, place: Column) -> Column:
    """A question's id, or q and its place."""
    return F.coalesce(F.nullif(own, F.lit("")), F.concat(F.lit("q"), F.format_string("%04d", place)))


def with_keys(samples: DataFrame) -> DataFrame:
    """Adds ``doc_keys, page_keys, chunk_ids, key_index, kept_contexts``.

    They come from the retrieved chunks, or where there are none, from the
    citations; contexts of the sample win over snippets, blank ones go.
    """
    own = F.size(F.filter("retrieved_chunk_ids", lambda x: x.isNotNull())) > 0
    texts = lambda c: F.coalesce(c, F.expr(NO_TEXTS))
    cited = F.coalesce("citations", F.expr("CAST(array() AS array<struct<company:string,filing:string,source_url:string,page:int,chunk_id:string,section:string,text_snippet:string>>)"))
    key = lambda c: T.page_key(T.doc_key(c["filing"]), c["page"])
    named = F.filter(cited, lambda c: F.coalesce(c["chunk_id"], F.lit("")) != "")
    last = F.filter(named, lambda c, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda d: d["chunk_id"] == c["chunk_id"]))
    index = F.map_from_entries(F.transform(last, lambda c: F.struct(c["chunk_id"], key(c))))
    contexts = F.when(F.size("contexts") > 0, F.col("contexts")).otherwise(F.transform(cited, lambda c: c["text_snippet"]))
    return samples.withColumns(
        {
            "doc_keys": F.when(own, texts("retrieved_doc_keys")).otherwise(F.transform(cited, lambda c: T.doc_key(c["filing"]))),
            "page_keys": F.when(own, texts("retrieved_page_keys")).otherwise(F.transform(cited, key)),
            "chunk_ids": F.when(own, texts("retrieved_chunk_ids")).otherwise(F.transform(cited, lambda c: c["chunk_id"])),
            "key_index": F.when(own, F.coalesce("chunk_key_index", F.expr("CAST(map() AS map<string,string>)"))).otherwise(index),
            "kept_contexts": F.filter(contexts, lambda x: x != ""),
        }
    )


def judged(samples: DataFrame, judge: DataFrame, metrics: list[str]) -> DataFrame:
    """Samples with the judge's scores for their ``question_id``; the last row of a question (by ``turn``) counts.

    NaN and missing scores are null; a sample without a row stays, without scores.
    """
    last = judge.groupBy("question_id").agg(F.max_by(F.struct(*metrics), "turn").alias("scores"))
    score = lambda m: F.when(~F.isnan(f"scores.{m}"), F.col(f"scores.{m}")).alias(m)
    return samples.join(last, "question_id", "left").select(*samples.columns, *[score(m) for m in metrics])


def second_pass(checkpoint: DataFrame, questions: DataFrame) -> DataFrame:
    """The samples of a checkpoint whose question is selected, with ``reference`` and ``reference_contexts``.

    Raises an error where the checkpoint has none of the questions.
    """
    contexts = F.filter(F.transform("evidence", lambda e: e["evidence_text"]), lambda t: t != "")
    known = questions.select(
        F.col("financebench_id").alias("question_id"),
        F.coalesce("answer", F.lit("")).alias("reference"),
        F.coalesce(contexts, F.expr(NO_TEXTS)).alias("reference_contexts"),
    )
    rows = checkpoint.join(known, "question_id")
    if rows.isEmpty():
        raise ValueError("the selected questions do not exist in the checkpoint of the first pass")
    return rows


def unsupported(requested: DataFrame, allowed: list[str]) -> DataFrame:
    """The requested names (``name``) that are not allowed, each once."""
    return requested.select("name").distinct().filter(~F.col("name").isin(allowed))


def report_columns(samples: DataFrame) -> DataFrame:
    """The columns of the report's table: rates to four places, latency to one, the judge's scores as they are."""
    scores = ["faithfulness", "answer_relevancy", "answer_correctness", "context_precision", "context_recall"]
    first = [c for c in ("sample_id",) if c in samples.columns]
    return samples.select(
        *first, "question_id", "question", "status", "gold_answer", "predicted_answer",
        F.round("citation_coverage", 4).alias("citation_coverage"), F.round("citation_validity", 4).alias("citation_validity"),
        *[F.col(f"generation.{m}").alias(m) for m in scores], F.round("latency_ms", 1).alias("latency_ms"), "retry_count", "error",
    )
