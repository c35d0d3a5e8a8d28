"""Rank fusion, bonuses, page neighbours and page diversification as set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as T

RRF_K = 60
SECTION_BONUS, TABLE_BONUS = 0.01, 0.004
SAME_PAGE, NEXT_PAGE = 1e-4, 5e-4  # what a neighbour's score lies below its anchor's
PER_PAGE = 3
META = ["doc_id", "page", "section", "content_type"]


def reciprocal_rank_fusion(lists: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, score, seen)`` of ranked lists ``(query_id, list_no, rank, chunk_id)``.

    A chunk counts once per list, at its best rank; ``seen`` orders chunks by
    their first appearance.
    """
    once = lists.groupBy("query_id", "list_no", "chunk_id").agg(F.min("rank").alias("rank"))
    return once.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min(F.col("list_no") * 10000 + F.col("rank")).alias("seen")
    )


def bonus(question: Column, section: Column, kind: Column, goal: Column | None = None) -> Column:
    """What wording, section and content type add to a chunk's score when ranking."""
    wants = T.prefers_tables(question)
    if goal is not None:
        wants = wants & F.coalesce(goal == "numeric_table", F.lit(True))
    in_section = F.coalesce(F.array_contains(T.preferred_sections(question), section), F.lit(False))
    return F.when(in_section, SECTION_BONUS).otherwise(0.0) + F.when(wants & (kind == "table"), TABLE_BONUS).otherwise(0.0)


def valued(scored: DataFrame, questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Scored chunks with their metadata, question and ranking ``value``; a question may have a ``goal``."""
    asked = questions.select("query_id", "question", *[c for c in ("goal",) if c in questions.columns])
    return with_value(scored.join(docs.select("chunk_id", *META), "chunk_id").join(asked, "query_id"))


def with_value(rows: DataFrame) -> DataFrame:
    """Rows ``(score, question, section, content_type)``, perhaps with a ``goal``, and their ranking ``value``."""
    goal = F.col("goal") if "goal" in rows.columns else None
    return rows.withColumn("value", F.round(F.col("score") + bonus(F.col("question"), F.col("section"), F.col("content_type"), goal), 9))


def ranked(rows: DataFrame) -> DataFrame:
    """Place of each chunk by value; equal values keep the order of appearance, then of ids."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("value"), "seen", "chunk_id")))


def page_neighbours(fused: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Chunks of the same and the adjacent pages of the k best, not yet found.

    A chunk near several anchors takes its score from the first of them; null
    pages have no neighbours.
    """
    anchors = fused.filter((F.col("place") <= k) & F.col("page").isNotNull())
    offsets = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(o).alias("by")) for i, o in enumerate((0, -1, 1))])
    carried = [c for c in ("question", "goal") if c in fused.columns]
    window = anchors.select("query_id", "place", "score", "doc_id", "page", *carried, F.explode(offsets).alias("o"))
    window = window.select("query_id", "place", "score", "doc_id", *carried, (F.col("page") + F.col("o.by")).alias("page"), F.col("o.turn").alias("turn"))
    near = window.join(docs.select("doc_id", "page", "chunk_id", *[c for c in META[2:] if c in docs.columns]), ["doc_id", "page"])
    fresh = near.join(fused.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    first = fresh.withColumn("at", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("place", "turn"))).filter("at = 1")
    score = F.col("score") - F.when(F.col("turn") == 0, SAME_PAGE).otherwise(NEXT_PAGE)
    seen = F.lit(1_000_000) + F.col("place") * 10 + F.col("turn")
    return first.withColumn("score", score).withColumn("seen", seen.cast("bigint")).drop("place", "turn", "at")


def term_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct terms that the text has (the offline scorer)."""
    asked = F.array_distinct(T.terms(question))
    share = F.size(F.array_intersect(asked, T.terms(text))) / F.nullif(F.size(asked), F.lit(0))
    return F.coalesce(share, F.lit(0.0))


def reranked(placed: DataFrame, docs: DataFrame, scorer: Callable[[Column, Column], Column], window: int) -> DataFrame:
    """The first ``window`` places in the order of the scorer, equal scores as before; the rest follows unchanged.

    The scorer sees the text alone, without its header.  ``model_score`` is
    null behind the window.
    """
    texts = docs.select("chunk_id", "text")
    first = placed.filter(F.col("place") <= window).join(texts, "chunk_id")
    scored = first.withColumn("model_score", F.round(scorer(F.col("question"), F.col("text")), 6)).drop("text")
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("model_score"), "place"))
    rest = placed.filter(F.col("place") > window).withColumn("model_score", F.lit(None).cast("double"))
    return scored.withColumn("place", order).unionByName(rest)


def diversify(rows: DataFrame, k: int) -> DataFrame:
    """At most ``PER_PAGE`` chunks of a page: first each page's best chunk and best table, then the rest.

    ``rows`` are placed; the k kept ones get their final ``rank``.
    """
    page = W.partitionBy("query_id", "doc_id", "page")
    table = F.col("content_type") == "table"
    marked = rows.withColumn("page_no", F.row_number().over(page.orderBy("place"))).withColumn(
        "table_no", F.sum(F.coalesce(table.cast("int"), F.lit(0))).over(page.orderBy("place"))
    )
    early = (F.col("page_no") == 1) | (F.coalesce(table, F.lit(False)) & (F.col("table_no") == 1))
    marked = marked.withColumn("early", early.cast("int"))
    marked = marked.withColumn("early_n", F.sum("early").over(page)).withColumn(
        "late_no", F.sum(1 - F.col("early")).over(page.orderBy("place"))
    )
    kept = marked.filter((F.col("early") == 1) | (F.col("early_n") + F.col("late_no") <= PER_PAGE))
    order = W.partitionBy("query_id").orderBy(F.desc("early"), "place")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*rows.columns, "rank")
