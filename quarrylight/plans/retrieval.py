"""Registered retrieval queries: lexical, dense and hybrid search for every question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import dense, fusion, hybrid, lexical
from quarrylight.operators.best import top_k
from quarrylight.plans import oracle as O
from quarrylight.session import materialise, table
from quarrylight.settings import Settings

SETTINGS = Settings.from_environment()
TOP_K = SETTINGS.top_k_hybrid
DENSE_DEPTH, DEPTH = hybrid.depth(TOP_K, SETTINGS)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, question, query)``."""
    q = table(spark, sf_dir, "questions").filter(F.col("financebench_id").isNotNull())
    return q.select(F.col("financebench_id").alias("query_id"), "question", F.col("question").alias("query")).distinct()


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus(table(spark, sf_dir, "chunks"))


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("terms")
    rows = lexical.indexed_rows(docs(spark, sf_dir))
    return rows.select("chunk_id", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


def index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    return lexical.Index.build(docs(spark, sf_dir))


def corpus(spark: SparkSession, sf_dir: str) -> hybrid.Corpus:
    return hybrid.Corpus.build(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_vectors"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(lexical.indexed_rows(docs(spark, sf_dir))).select("n", F.round("avgdl", 6).alias("avgdl"))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(lexical.indexed_rows(docs(spark, sf_dir)), "index")
    return lexical.term_stats(rows).select("term", "df", F.round("idf", 6).alias("idf"))


def keyword_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", T.keyword_query(F.col("question")).alias("keywords"))


def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.forms_of(questions(spark, sf_dir)).select("query_id", "list_no", "query")


def question_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("question")
    return questions(spark, sf_dir).select(
        "query_id",
        F.array_join(T.preferred_sections(c), ",").alias("sections"),
        T.prefers_tables(c).alias("tables"),
        T.conditional_zero(c).alias("conditional_zero"),
        T.zero_instruction(c).alias("instruction"),
        F.array_join(T.years(c).cast("array<string>"), ",").alias("years"),
    )


def infer_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.infer_filters(questions(spark, sf_dir), table(spark, sf_dir, "chunks"))


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions with their own company as a stated filter; every third one states a blank company, every fifth a year."""
    q = table(spark, sf_dir, "questions").filter(F.col("financebench_id").isNotNull()).dropDuplicates(["financebench_id"])
    number = F.regexp_extract("financebench_id", "([0-9]+)", 1).cast("int")
    return q.select(
        F.col("financebench_id").alias("query_id"),
        "question",
        F.when(number % 3 == 0, "").otherwise(F.col("company")).alias("company"),
        F.when(number % 5 == 0, 2019).alias("fiscal_year"),
    )


def filter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated filters merged with those that the wording names."""
    s = stated(spark, sf_dir)
    inferred = lexical.infer_filters(s.select("query_id", F.col("question").alias("query")), table(spark, sf_dir, "chunks"))
    return lexical.merged_filters(s, inferred)


def filter_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the merged filters for the chunks (company without regard to case)."""
    return lexical.relaxed_filters(filter_merge(spark, sf_dir), docs(spark, sf_dir))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(lexical.best_matches(questions(spark, sf_dir), index(spark, sf_dir), 10))


def bm25_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    hits = lexical.relaxed_top_k(q, index(spark, sf_dir), lexical.infer_filters(q, table(spark, sf_dir, "chunks")), 10)
    return _shown(hits).select("query_id", "tier", "chunk_id", "score", "rank")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 vectors most similar to each whose id is divisible by 100, itself left out."""
    v = dense.usable_vectors(table(spark, sf_dir, "chunk_vectors")).select("embedding", F.format_string("%018d", "vec_id").alias("chunk_id"), "vec_id")
    asked = v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    hits = dense.nearest(asked, v.drop("vec_id"), 11).withColumn("vec_id", F.col("chunk_id").cast("bigint"))
    best = top_k(hits.filter(F.col("vec_id") != F.col("query_id")).drop("rank"), 10, ["query_id"])
    return _shown(best).select("query_id", "vec_id", "score", "rank")


def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar chunks of the same company (compared case by case) for those vectors."""
    v = dense.usable_vectors(table(spark, sf_dir, "chunk_vectors"))
    known = v.join(docs(spark, sf_dir).select("chunk_id", "company"), "chunk_id").filter(F.col("company").isNotNull())
    named = known.select("embedding", "company", F.format_string("%018d", "vec_id").alias("chunk_id"), "vec_id")
    asked = named.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding", "company").dropDuplicates(["query_id"])
    hits = dense.nearest(asked, named.drop("vec_id"), 6).withColumn("vec_id", F.col("chunk_id").cast("bigint"))
    best = top_k(hits.filter(F.col("vec_id") != F.col("query_id")).drop("rank"), 5, ["query_id"])
    return _shown(best).select("query_id", "vec_id", "score", "rank")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions without stated filters and without a goal."""
    none = F.lit(None)
    return questions(spark, sf_dir).select("query_id", "question", none.cast("string").alias("company"), none.cast("int").alias("fiscal_year"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidates by fused score: dense and lexical lists of every query form under relaxed filters."""
    fused = hybrid.candidates(_asked(spark, sf_dir), corpus(spark, sf_dir), TOP_K, SETTINGS)
    return _shown(top_k(fused, TOP_K, ["query_id"])).select("query_id", "chunk_id", "score", "rank")


def page_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = _asked(spark, sf_dir), corpus(spark, sf_dir)
    start = fusion.ranked(fusion.valued(hybrid.candidates(q, c, TOP_K, SETTINGS), q, c.docs))
    return _shown(fusion.page_neighbours(start, c.docs, TOP_K)).select("query_id", "chunk_id", "score")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: filters, lists, fusion, bonuses, page neighbours, diversification."""
    return _shown(hybrid.search(_asked(spark, sf_dir), corpus(spark, sf_dir), TOP_K))


def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under stated filters, which are kept even where nothing meets them, for narrative evidence."""
    asked = stated(spark, sf_dir).withColumn("goal", F.lit("narrative_explanation"))
    return _shown(hybrid.search(asked, corpus(spark, sf_dir), TOP_K))


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search with the first 60 candidates in the order of the offline scorer, the others behind them."""
    return _shown(hybrid.search(_asked(spark, sf_dir), corpus(spark, sf_dir), TOP_K, scorer=fusion.term_overlap))


_S6 = "round(score, 6) AS score"
_REACH = f"""have AS (SELECT DISTINCT {O.fold("company")} AS c, company, fiscal_year AS y FROM corpus),
lexf AS (SELECT *, CASE WHEN company IS NOT NULL AND EXISTS (SELECT 1 FROM have WHERE c = {O.fold("filters.company")} AND y = fiscal_year) THEN fiscal_year
    WHEN company IS NULL AND EXISTS (SELECT 1 FROM have WHERE y = fiscal_year) THEN fiscal_year END AS year FROM filters)"""


def _fused(filters: str, asked: str = "q") -> str:
    """CTEs from the filters to the fused lists."""
    return f"""{O.CORPUS}, {asked}, {O.INDEX}, {O.VARIANTS}, {O.VECTORS}, {filters}, {_REACH},
asked AS (SELECT query_id || chr(31) || list_no AS query_id, query FROM variants), {O.scores("bm", "asked")},
bm_all AS (SELECT v.query_id || chr(31) || v.list_no AS query_id, c.chunk_id, coalesce(bm.score, 0.0) AS score
    FROM variants v JOIN lexf f USING (query_id) JOIN corpus c ON (f.company IS NULL OR {O.fold("c.company")} = {O.fold("f.company")}) AND (f.year IS NULL OR c.fiscal_year = f.year)
    LEFT JOIN bm ON bm.query_id = v.query_id || chr(31) || v.list_no AND bm.chunk_id = c.chunk_id),
lexical AS ({O.top(DEPTH, "bm_all")}),
one AS (SELECT u.chunk_id, any_value(c.company) AS company, any_value(c.fiscal_year) AS fiscal_year, arg_min(e, vec_id) AS e, arg_min(norm, vec_id) AS norm
    FROM units u JOIN corpus c USING (chunk_id) GROUP BY u.chunk_id),
lead AS (SELECT query_id, arg_min(e, rank) AS e, arg_min(norm, rank) AS norm FROM lexical JOIN one USING (chunk_id) GROUP BY query_id),
densef AS (SELECT *, CASE WHEN company IS NOT NULL AND EXISTS (SELECT 1 FROM one o WHERE o.company = filters.company AND o.fiscal_year = filters.fiscal_year) THEN fiscal_year
    WHEN company IS NULL AND EXISTS (SELECT 1 FROM one o WHERE o.fiscal_year = filters.fiscal_year) THEN fiscal_year END AS year FROM filters),
sims AS (SELECT a.query_id, b.chunk_id, {O.COSINE} AS score FROM lead a JOIN densef f ON f.query_id = split_part(a.query_id, chr(31), 1)
    JOIN one b ON (f.company IS NULL OR b.company = f.company) AND (f.year IS NULL OR b.fiscal_year = f.year)),
lists AS (SELECT query_id, rank, chunk_id, {hybrid.LEXICAL} AS base FROM lexical UNION ALL SELECT query_id, rank, chunk_id, {hybrid.DENSE} FROM ({O.top(DENSE_DEPTH, "sims")})),
fused AS (SELECT split_part(query_id, chr(31), 1) AS query_id, chunk_id, sum(1.0 / ({fusion.RRF_K} + rank)) AS score,
    min((CAST(split_part(query_id, chr(31), 2) AS INTEGER) + base) * 10000 + rank) AS seen FROM lists GROUP BY ALL)"""


_FUSED = _fused(O.FILTERS, O.QUESTIONS)
_PLACE = "row_number() OVER (PARTITION BY query_id ORDER BY value DESC, seen, chunk_id) AS place"
def _near(value: str = O.VALUE) -> str:
    return f"""start AS (SELECT *, {_PLACE} FROM (
    SELECT query_id, chunk_id, score, seen, doc_id, page, {value} AS value FROM fused JOIN corpus USING (chunk_id) JOIN q USING (query_id))),
around AS (SELECT s.query_id, s.place, s.score, o.turn, c.chunk_id FROM start s, (VALUES (0, 0), (1, -1), (2, 1)) o(turn, step), corpus c
    WHERE s.place <= {TOP_K} AND c.doc_id = s.doc_id AND c.page = s.page + o.step
      AND NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = s.query_id AND f.chunk_id = c.chunk_id)),
near AS (SELECT query_id, chunk_id, score - CASE WHEN turn = 0 THEN {fusion.SAME_PAGE} ELSE {fusion.NEXT_PAGE} END AS score, 1000000 + place * 10 + turn AS seen
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY place, turn) AS nth FROM around) WHERE nth = 1)"""


def _placed(value: str = O.VALUE) -> str:
    return f"""{_near(value)}, placed AS (SELECT *, {_PLACE} FROM (
    SELECT query_id, chunk_id, score, seen, question, text, doc_id, page, content_type, {value} AS value
    FROM (SELECT * FROM fused UNION ALL SELECT * FROM near) JOIN corpus USING (chunk_id) JOIN q USING (query_id)))"""


_PAGE = "PARTITION BY query_id, doc_id, page"


def _diversified(source: str) -> str:
    return f"""one_ AS (SELECT *, coalesce(content_type = 'table', false) AS tab, row_number() OVER ({_PAGE} ORDER BY place) AS page_no FROM {source}),
        two AS (SELECT *, CAST(page_no = 1 OR (tab AND sum(CAST(tab AS INTEGER)) OVER ({_PAGE} ORDER BY place) = 1) AS INTEGER) AS early FROM one_),
        three AS (SELECT *, sum(early) OVER ({_PAGE}) AS early_n, sum(1 - early) OVER ({_PAGE} ORDER BY place) AS late_no FROM two),
        four AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY early DESC, place) AS rank FROM three WHERE early = 1 OR early_n + late_no <= {fusion.PER_PAGE})"""


_NUMBER = "CAST(regexp_extract(query_id, '([0-9]+)', 1) AS INTEGER)"
_STATED = f"""q AS (SELECT query_id, question, CASE WHEN {_NUMBER} % 3 = 0 THEN '' ELSE company END AS stated, CASE WHEN {_NUMBER} % 5 = 0 THEN 2019 END AS stated_year FROM
    (SELECT DISTINCT ON (financebench_id) financebench_id AS query_id, question, company FROM questions WHERE financebench_id IS NOT NULL ORDER BY financebench_id))"""
_INFERRED = O.FILTERS.replace("filters AS (", "inferred AS (")
_MERGED = """filters AS (SELECT query_id, coalesce(nullif(stated, ''), nullif(i.company, '')) AS company, coalesce(stated_year, i.fiscal_year) AS fiscal_year,
    stated IS NOT NULL OR stated_year IS NOT NULL AS explicit FROM q LEFT JOIN inferred i USING (query_id))"""
_GOAL_VALUE = f"round(score + CASE WHEN list_contains({O.preferred('question')}, section) THEN {fusion.SECTION_BONUS} ELSE 0.0 END, 9)"

SQL = {
    "tokenize_terms": f"""WITH {O.CORPUS}, t AS (SELECT chunk_id, {O.terms("indexed")} AS t FROM corpus)
        SELECT chunk_id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct, array_to_string(t[1:5], ' ') AS head FROM t""",
    "corpus_stats": f"WITH {O.CORPUS}, {O.INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "term_stats": f"WITH {O.CORPUS}, {O.INDEX} SELECT term, df, round(idf, 6) AS idf FROM idfs",
    "keyword_query": f"WITH {O.QUESTIONS} SELECT query_id, {O.keywords('question')} AS keywords FROM q",
    "query_variants": f"WITH {O.QUESTIONS}, {O.VARIANTS} SELECT query_id, list_no, query FROM variants",
    "question_flags": f"""WITH {O.QUESTIONS} SELECT query_id, array_to_string({O.preferred("question")}, ',') AS sections,
        regexp_matches({O.fold("question")}, {O.quoted(T.TABLE_CUE)}) AS tables,
        regexp_matches({O.fold("question")}, {O.quoted(T.ZERO_CUE)}) AS conditional_zero,
        CASE WHEN regexp_matches({O.fold("question")}, {O.quoted(T.ZERO_CUE)}) THEN {O.quoted(T.ZERO_INSTRUCTION)} ELSE {O.quoted(T.NO_ZERO_INSTRUCTION)} END AS instruction, array_to_string({O.years("question")}, ',') AS years FROM q""",
    "infer_filters": f"WITH {O.QUESTIONS}, {O.FILTERS} SELECT * FROM filters",
    "filter_merge": f"""WITH {O.CORPUS}, {_STATED}, {_INFERRED}, {_MERGED} SELECT * FROM filters""",
    "filter_relaxation": f"""WITH {O.CORPUS}, {_STATED}, {_INFERRED}, {_MERGED}, {_REACH}
        SELECT query_id, company, year AS fiscal_year, CAST(CASE WHEN company IS NULL AND year IS NULL THEN 2 WHEN fiscal_year IS NULL OR year IS NOT NULL THEN 0 ELSE 1 END AS INTEGER) AS tier FROM lexf""",
    "bm25_topk": f"""WITH {O.CORPUS}, {O.QUESTIONS}, {O.INDEX}, asked AS (SELECT query_id, question AS query FROM q), {O.scores("bm", "asked")},
        every AS (SELECT query_id, chunk_id, coalesce(score, 0.0) AS score FROM q CROSS JOIN corpus LEFT JOIN bm USING (query_id, chunk_id))
        SELECT query_id, chunk_id, {_S6}, rank FROM ({O.top(10, "every")})""",
    "bm25_relaxed": f"""WITH {O.CORPUS}, {O.QUESTIONS}, {O.INDEX}, {O.FILTERS}, asked AS (SELECT query_id, question AS query FROM q), {O.scores("bm", "asked")},
        reach AS (SELECT f.query_id, c.chunk_id,
            CASE WHEN f.company IS NULL OR f.fiscal_year IS NULL OR coalesce(f.fiscal_year = c.fiscal_year, false) THEN 0 ELSE 1 END AS tier
            FROM filters f, corpus c WHERE (f.company IS NOT NULL AND lower(f.company) = lower(c.company))
               OR (f.company IS NULL AND f.fiscal_year = c.fiscal_year)),
        least AS (SELECT query_id, min(tier) AS tier FROM reach GROUP BY query_id),
        held AS (SELECT query_id, tier, chunk_id, coalesce(score, 0.0) AS score FROM reach JOIN least USING (query_id, tier) LEFT JOIN bm USING (query_id, chunk_id)
            UNION ALL SELECT query_id, 2, chunk_id, coalesce(score, 0.0) FROM q CROSS JOIN corpus LEFT JOIN bm USING (query_id, chunk_id) WHERE query_id NOT IN (SELECT query_id FROM least))
        SELECT query_id, tier, chunk_id, {_S6}, rank FROM ({O.top(10, "held")})""",
    "dense_topk": f"""WITH {O.VECTORS}, sims AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {O.COSINE} AS score
            FROM units a, units b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, chunk_id AS vec_id, {_S6}, rank FROM ({O.top(10, "sims")})""",
    "dense_filtered": f"""WITH {O.CORPUS}, {O.VECTORS}, known AS (SELECT units.*, company FROM units JOIN corpus USING (chunk_id)),
        sims AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {O.COSINE} AS score
            FROM known a JOIN known b ON a.company = b.company WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, chunk_id AS vec_id, {_S6}, rank FROM ({O.top(5, "sims")})""",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, chunk_id, {_S6}, rank FROM ({O.top(TOP_K, 'fused')})",
    "page_neighbours": f"WITH {_FUSED}, {_near()} SELECT query_id, chunk_id, {_S6} FROM near",
    "rerank": f"""WITH {_FUSED}, {_placed()}, m AS (SELECT *, CASE WHEN place <= {max(5 * TOP_K, 50)} THEN
            round(coalesce(len(list_intersect({O.terms("question")}, {O.terms("text")})) / nullif(len(list_distinct({O.terms("question")})), 0), 0.0), 6) END AS model FROM placed),
        moved AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY place > {max(5 * TOP_K, 50)}, model DESC, place) AS place) FROM m), {_diversified("moved")}
        SELECT query_id, rank, chunk_id, doc_id, page, {_S6} FROM four WHERE rank <= {TOP_K}""",
    "hybrid_search": f"""WITH {_FUSED}, {_placed()}, {_diversified("placed")} SELECT query_id, rank, chunk_id, doc_id, page, {_S6} FROM four WHERE rank <= {TOP_K}""",
    "hybrid_filtered": f"""WITH {_fused(f"{_INFERRED}, {_MERGED}", _STATED)}, {_placed(_GOAL_VALUE)}, {_diversified("placed")}
        SELECT query_id, rank, chunk_id, doc_id, page, {_S6} FROM four WHERE rank <= {TOP_K}""",
}
QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, corpus_stats, term_stats, keyword_query, query_variants, question_flags, infer_filters, filter_merge, filter_relaxation,
        bm25_topk, bm25_relaxed, dense_topk, dense_filtered, rrf_fusion, page_neighbours, rerank, hybrid_search, hybrid_filtered,
    )
}
