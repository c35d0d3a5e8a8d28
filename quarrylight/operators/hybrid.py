"""Hybrid search for a batch of questions: query forms, filters, fusion, neighbours, reranking, diversification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import dense, fusion, lexical
from quarrylight.session import materialise, together
from quarrylight.settings import Settings

DENSE, LEXICAL = 0, 10  # what is added to a form's number to number its lists: dense lists come first


@dataclass(frozen=True)
class Corpus:
    """What a search reads, written once.

    Chunks, the lexical index, one vector per chunk with its metadata, and the
    companies and years that chunks and vectors have.
    """

    docs: DataFrame
    index: lexical.Index
    vectors: DataFrame
    places: DataFrame
    vector_places: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame, vectors: DataFrame, width: int = 64) -> Corpus:
        docs = materialise(lexical.corpus(chunks), "corpus")
        one = dense.usable_vectors(vectors, width).groupBy("chunk_id").agg(F.min_by("embedding", "vec_id").alias("embedding"))
        placed = one.join(docs.select("chunk_id", "company", "fiscal_year"), "chunk_id")
        places = lambda rows: materialise(rows.select("company", "fiscal_year").distinct(), "places")

        def dense_part() -> tuple[DataFrame, DataFrame]:
            held = materialise(placed, "vectors")
            return held, places(held)

        index, known, (held, vector_known) = together(lambda: lexical.Index.build(docs), lambda: places(docs), dense_part)
        return cls(docs, index, held, known, vector_known)


def depth(top_k: int, settings: Settings) -> tuple[int, int]:
    """Candidates per dense and per lexical list."""
    return max(settings.top_k_dense, 5 * top_k), max(settings.top_k_bm25, 5 * top_k)


def forms_of(questions: DataFrame) -> DataFrame:
    """``(query_id, question, list_no, query)``: the forms of each question, numbered from 1."""
    each = questions.select("query_id", "question", F.posexplode(T.query_variants(F.col("question"))).alias("i", "query"))
    return each.select("query_id", "question", (F.col("i") + 1).alias("list_no"), "query")


def keyed_forms(questions: DataFrame) -> DataFrame:
    """``(query_id, form, query)``: the forms of each question under keys of their own, written."""
    key = F.concat_ws("\x1f", "query_id", F.col("list_no").cast("string"))
    return materialise(forms_of(questions).select("query_id", key.alias("form"), "query"), "forms")


def lists_for(forms: DataFrame, filters: DataFrame, corpus: Corpus, top_k: int, settings: Settings) -> DataFrame:
    """``(query_id, list_no, rank, chunk_id)``: a dense and a lexical list for each form, under relaxed filters.

    Offline there is no model to embed a form: its vector is that of its best
    lexical match that has one (pseudo-relevance).  Lexical filters meet
    company names without regard to case, dense ones case by case.
    """
    n_dense, n_lexical = depth(top_k, settings)

    def under(relaxed: DataFrame, ids: DataFrame) -> DataFrame:
        return ids.join(relaxed.drop("tier"), "query_id", "left").drop("query_id").withColumnRenamed("form", "query_id")

    asked = under(lexical.relaxed_filters(filters, corpus.places), forms)
    words = materialise(lexical.best_matches(asked, corpus.index, n_lexical), "lexical")
    lead = words.join(corpus.vectors.select("chunk_id", "embedding"), "chunk_id").groupBy("query_id").agg(F.min_by("embedding", "rank").alias("embedding"))
    split = F.substring_index("query_id", "\x1f", 1)
    named = lead.select(split.alias("query_id"), F.col("query_id").alias("form"), "embedding")
    near = dense.nearest(under(lexical.relaxed_filters(filters, corpus.vector_places, F.col), named), corpus.vectors, n_dense)
    number = F.substring_index("query_id", "\x1f", -1).cast("int")
    listed = lambda hits, base: hits.select(split.alias("query_id"), (number + base).alias("list_no"), "rank", "chunk_id")
    return listed(near, DENSE).unionByName(listed(words, LEXICAL))


def candidates(questions: DataFrame, corpus: Corpus, top_k: int, settings: Settings) -> DataFrame:
    """Fused candidates ``(query_id, chunk_id, score, seen)`` of the questions.

    ``questions`` has ``query_id, question, company, fiscal_year``; stated
    filters win over those that the wording names.  Where inferred filters
    leave every list of a question empty, it is searched again without any;
    stated filters are never dropped like this.
    """
    questions = materialise(questions, "questions")
    inferred = lexical.infer_filters(questions.select("query_id", F.col("question").alias("query")), corpus.places)
    filters, forms = together(lambda: materialise(lexical.merged_filters(questions, inferred), "filters"), lambda: keyed_forms(questions))
    lists = materialise(lists_for(forms, filters, corpus, top_k, settings), "lists")
    empty = questions.join(lists.select("query_id").distinct(), "query_id", "left_anti").join(filters.filter("NOT explicit"), "query_id", "left_semi")
    if not empty.isEmpty():
        free = empty.select("query_id", F.lit(None).cast("string").alias("company"), F.lit(None).cast("int").alias("fiscal_year"))
        lists = lists.unionByName(lists_for(forms.join(empty.select("query_id"), "query_id", "left_semi"), free, corpus, top_k, settings))
    return materialise(fusion.reciprocal_rank_fusion(lists), "fused")


def place(questions: DataFrame, corpus: Corpus, fused: DataFrame, top_k: int) -> DataFrame:
    """Candidates and the neighbours of the best, with metadata, value and place."""
    start = fusion.ranked(fusion.valued(fused, questions, corpus.docs))
    near = fusion.with_value(fusion.page_neighbours(start, corpus.docs, top_k))
    return fusion.ranked(start.drop("place").unionByName(near))


def search(
    questions: DataFrame,
    corpus: Corpus,
    top_k: int | None = None,
    settings: Settings | None = None,
    scorer: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """``(query_id, rank, chunk_id, doc_id, page, score)``: the hybrid search of every question.

    ``questions`` has ``query_id`` and ``question`` and may have ``company``,
    ``fiscal_year`` (stated filters) and ``goal`` (what evidence is looked
    for).  ``scorer`` maps question and text to a column and reorders the first
    candidates (without one, only if the settings ask for it); scores stay
    those of the fusion.
    """
    s = settings or Settings.from_environment()
    top_k = top_k or s.top_k_hybrid
    for name, kind in (("company", "string"), ("fiscal_year", "int"), ("goal", "string")):
        if name not in questions.columns:
            questions = questions.withColumn(name, F.lit(None).cast(kind))
    placed = place(questions, corpus, candidates(questions, corpus, top_k, s), top_k)
    if scorer is None and s.use_reranker:
        scorer = fusion.term_overlap
    if scorer is not None:
        placed = fusion.reranked(placed, corpus.docs, scorer, max(5 * top_k, 50))
    return fusion.diversify(placed, top_k).select("query_id", "rank", "chunk_id", "doc_id", "page", "score")
