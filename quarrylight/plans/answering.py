"""Registered queries of the corrective question-answering loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import citations, corrective, hybrid
from quarrylight.plans import evaluation
from quarrylight.plans import oracle as O
from quarrylight.plans import retrieval


def graded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 hits of the hybrid search for each question with the offline grader's verdict."""
    q, c = retrieval._asked(spark, sf_dir), retrieval.corpus(spark, sf_dir)
    asked = q.select("query_id", F.col("question").alias("active"), F.lit(0).alias("retry"))
    graded = corrective.graded(hybrid.search(q, c, retrieval.TOP_K), c.docs, asked, corrective.Providers())
    return graded.select("query_id", "chunk_id", "rank", "score", "verdict")


def debug_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of the hybrid search as a debugging view shows them: place, provenance and 400 characters."""
    c = retrieval.corpus(spark, sf_dir)
    hits = hybrid.search(retrieval._asked(spark, sf_dir), c, retrieval.TOP_K).select("query_id", "rank", "chunk_id", "score")
    seen = hits.join(c.docs.select("chunk_id", "company", "fiscal_year", "page", "section", "content_type", "text"), "chunk_id")
    return seen.select(
        "query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "company", "fiscal_year", "page", "section", "content_type",
        F.substring("text", 1, 400).alias("preview"),
    )


def classified_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels read from the classifier's replies; replies come bare, in a fence, inside prose, broken and without an object."""
    q = retrieval.questions(spark, sf_dir)
    reply = corrective.offline_reply(F.col("question"))
    number = F.regexp_extract("query_id", "([0-9]+)", 1).cast("int") % 5
    dressed = (
        F.when(number == 0, reply)
        .when(number == 1, F.concat(F.lit("{x} Sure:\n```json\n"), reply, F.lit("\n```\n{y}")))
        .when(number == 2, F.concat(F.lit("Result: "), reply, F.lit(" as asked")))
        .when(number == 3, F.concat(F.lit("{"), reply))
        .otherwise("I cannot tell.")
    )
    c = q.select("query_id", dressed.alias("reply")).select("query_id", corrective.classified(F.col("reply")).alias("c"))
    return c.select("query_id", "c.question_type", F.array_join("c.reasoning", ",").alias("reasoning"), "c.requires_calculation", "c.multi_year")


def decomposed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each question with the evidence goal of every hop, also of one hop beyond the parts."""
    q = retrieval.questions(spark, sf_dir)
    parts = corrective.parts_of(F.col("question"), corrective.offline_parts(F.col("question")), corrective.MAX_HOPS)
    held = q.select("query_id", parts.alias("parts"))
    hop = F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("hop")
    each = held.select("query_id", "parts", hop)
    goals = F.transform("parts", lambda x: x["evidence_goal"])
    asked = F.try_element_at("parts", F.col("hop") + 1)["question"]
    return each.select("query_id", "hop", asked.alias("part"), corrective.active_goal(goals, F.col("hop")).alias("goal"))


def chunk_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as a citation, every seventh as if its document were unknown."""
    d = retrieval.docs(spark, sf_dir)
    named = F.when(F.length("chunk_id") % 7 != 0, F.col("doc_id"))
    c = corrective.citation_of(F.col("company"), named, *[F.col(x) for x in ("fiscal_year", "doc_type", "source_url", "page", "chunk_id", "section", "text")])
    return d.select(c.alias("c")).select("c.*")


def validation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of each sample's citations: final status, whether the draft is repaired, and its length."""
    s = evaluation.answered(spark, sf_dir)
    cover = citations.coverage(s)
    n = F.coalesce(F.size("contexts"), F.lit(0))
    v = corrective.validation(F.col("coverage") == 1, n, F.coalesce("retry_count", F.lit(0)))
    done = s.join(cover, "sample_id").select("sample_id", "answer", v.alias("v"))
    final = F.when(F.col("v.repaired"), corrective.cite_first(F.col("answer"))).otherwise(F.col("answer"))
    return done.select("sample_id", "v.status", "v.repaired", F.length(final).alias("n_chars"))


def verdict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved chunks of each sample met with its citations as the grader's items."""
    s = evaluation.samples(spark, sf_dir).withColumn("query_id", F.col("sample_id"))
    candidates = s.select("query_id", F.posexplode("retrieved_chunk_ids").alias("pos", "chunk_id"))
    items = s.select("query_id", F.posexplode("citations").alias("pos", "c")).select(
        "query_id", "pos", "c.chunk_id", F.when(F.col("c.page").isNotNull(), "Relevant ").otherwise("irrelevant").alias("verdict"), F.lit(0.9).alias("score")
    )
    return corrective.join_verdicts(candidates, items)


def route_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The router's decision for a state read from each sample."""
    s = evaluation.samples(spark, sf_dir)
    accepted, evidence = F.coalesce(F.size("citations"), F.lit(0)), F.coalesce(F.size("contexts"), F.lit(0))
    hop, hops = (F.col("sample_id") % 2).cast("int"), F.lit(corrective.MAX_HOPS)
    step = corrective.next_step(accepted, F.coalesce("retry_count", F.lit(0)), evidence, hop, hops)
    return s.select("sample_id", step.alias("next_step"))


def distinct_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.samples(spark, sf_dir).select(F.col("sample_id").alias("query_id"), F.posexplode("citations").alias("pos", "c"))
    return corrective.distinct_evidence(s.select("query_id", "pos", "c.chunk_id", "c.section"))


def corrective_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question answered by the bounded loop with the offline providers."""
    return corrective.answer_all(retrieval.questions(spark, sf_dir).select("query_id", "question"), retrieval.corpus(spark, sf_dir))


def plain_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single pass: the first hits that fit the context budget, and the beginning of the first as the answer."""
    s = retrieval.SETTINGS
    q, c = retrieval._asked(spark, sf_dir), retrieval.corpus(spark, sf_dir)
    hits = hybrid.search(q, c, retrieval.TOP_K).join(c.docs.select("chunk_id", F.coalesce("text", F.lit("")).alias("text")), "chunk_id")
    texts = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("hits"))
    each = texts.select("query_id", F.posexplode(F.slice("hits", 1, s.answer_contexts)).alias("pos", "h")).select("query_id", "pos", "h.chunk_id", F.col("h.text").alias("context"))
    kept = evaluation.within_budget(each, "query_id", s.answer_characters)
    joined = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_contexts"), F.sum(F.length("context")).alias("n_chars"), F.min_by("context", "pos").alias("first"))
    known = q.select("query_id").join(joined, "query_id", "left")
    some = F.coalesce("n_contexts", F.lit(0)) > 0
    return known.select(
        "query_id",
        F.when(some, "answer").otherwise("abstain").alias("status"),
        F.when(some, F.substring("first", 1, 200)).otherwise(corrective.ABSTENTION).alias("answer"),
        F.coalesce("n_contexts", F.lit(0)).alias("n_contexts"),
        F.coalesce("n_chars", F.lit(0)).alias("n_chars"),
    )


_OVER = f"coalesce(len(list_intersect({O.terms('question')}, {O.terms('substring(text, 1, 2000)')})) / nullif(len(list_distinct({O.terms('question')})), 0), 0.0)"
_HITS = f"""{retrieval._FUSED}, {retrieval._placed()}, {retrieval._diversified("placed")}, hits AS (SELECT query_id, rank, chunk_id, score FROM four WHERE rank <= {retrieval.TOP_K})"""
_ZERO = f"""regexp_matches({O.fold("question")}, {O.quoted(T.ZERO_CUE)}) AND lower(trim(section)) = 'income statement'
    AND (len(regexp_extract_all(question, '\\b(20[0-9]{{2}})\\b')) = 0 OR list_contains(regexp_extract_all(question, '\\b(20[0-9]{{2}})\\b'), CAST(fiscal_year AS VARCHAR)))"""
_COMPUTES = f"regexp_matches({O.fold('question')}, 'ratio|margin|percent|change|growth|difference')"
_COMPARES = f"(len({O.years('question')}) > 1 OR regexp_matches({O.fold('question')}, 'improved|increase|decrease|since'))"
_S = evaluation._S
SQL = {
    "graded_candidates": f"""WITH {_HITS}, g AS (SELECT query_id, chunk_id, rank, coalesce({_ZERO}, false) AS zero, round({_OVER}, 6) AS raw
            FROM hits JOIN corpus USING (chunk_id) JOIN q USING (query_id) WHERE rank <= {corrective.GRADED}),
        z AS (SELECT query_id, chunk_id, rank, zero, CASE WHEN zero THEN greatest(raw, 0.8) ELSE raw END AS score FROM g)
        SELECT query_id, chunk_id, rank, score, CASE WHEN zero OR score >= {corrective.RELEVANT} THEN 'relevant' WHEN score >= {corrective.AMBIGUOUS} THEN 'ambiguous' ELSE 'irrelevant' END AS verdict FROM z""",
    "debug_projection": f"""WITH {_HITS} SELECT query_id, rank, chunk_id, round(score, 6) AS score, company, fiscal_year, page, section, content_type, substring(text, 1, 400) AS preview
        FROM hits JOIN corpus USING (chunk_id)""",
    "classified_questions": f"""WITH {O.QUESTIONS}, n AS (SELECT *, CAST(regexp_extract(query_id, '([0-9]+)', 1) AS INTEGER) % 5 < 3 AS good FROM q)
        SELECT query_id, CASE WHEN good AND {_COMPUTES} THEN 'numerical_reasoning' WHEN good AND {_COMPARES} THEN 'logical_reasoning' ELSE 'information_extraction' END AS question_type,
            'Information extraction' || CASE WHEN good AND {_COMPUTES} THEN ',Numerical reasoning' ELSE '' END || CASE WHEN good AND {_COMPARES} THEN ',Logical reasoning' ELSE '' END AS reasoning,
            good AND {_COMPUTES} AS requires_calculation, good AND {_COMPARES} AS multi_year FROM n""",
    "decomposed_questions": f"""WITH {O.QUESTIONS}, p AS (SELECT query_id, CASE WHEN regexp_matches({O.fold("question")}, {O.quoted(T.TABLE_CUE)}) THEN 'numeric_table' ELSE 'narrative_explanation' END AS g,
            CASE WHEN len({O.years("question")}) > 1 THEN list_transform({O.years("question")}[1:{corrective.MAX_HOPS}], lambda y: question || ' (' || y || ')') ELSE [question] END AS parts FROM q),
        h AS (SELECT query_id, g, parts, unnest(range(0, len(parts) + 1)) AS hop FROM p)
        SELECT query_id, CAST(hop AS INTEGER) AS hop, parts[hop + 1] AS part, CASE WHEN hop < len(parts) THEN g ELSE 'numeric_table' END AS goal FROM h""",
    "validation_outcomes": f"""WITH {_S}, {evaluation._COVER}, v AS (SELECT sample_id, answer, coverage = 1 AS passed, coalesce(len(contexts), 0) AS n, coalesce(retry_count, 0) AS r FROM a JOIN coverage USING (sample_id)),
        w AS (SELECT *, NOT passed AND r < {corrective.MAX_RETRIES} AND n > 0 AS repaired FROM v)
        SELECT sample_id, CASE WHEN n > 0 AND (passed OR repaired) THEN 'answer' ELSE 'abstain' END AS status, repaired,
            length(CASE WHEN repaired THEN array_to_string(list_transform({evaluation._SENT}, lambda x: CASE WHEN len({evaluation._markers("x")}) > 0 THEN x ELSE x || ' [1]' END), ' ') ELSE answer END) AS n_chars FROM w""",
    "chunk_citations": f"""WITH {O.CORPUS} SELECT coalesce(company, 'Unknown') AS company,
            CASE WHEN length(chunk_id) % 7 <> 0 AND doc_id <> '' THEN doc_id ELSE coalesce(CAST(fiscal_year AS VARCHAR), '?') || ' ' || coalesce(doc_type, '?') END AS filing,
            coalesce(source_url, '') AS source_url, page, chunk_id, coalesce(section, '') AS section, substring(coalesce(text, ''), 1, 200) AS text_snippet FROM corpus""",
    "verdict_join": f"""WITH {_S}, c AS (SELECT sample_id AS query_id, unnest(retrieved_chunk_ids) AS chunk_id, generate_subscripts(retrieved_chunk_ids, 1) - 1 AS pos FROM s),
        i0 AS (SELECT sample_id AS query_id, unnest(citations) AS x, generate_subscripts(citations, 1) - 1 AS pos FROM s),
        i AS (SELECT query_id, pos, lower(trim(x.chunk_id)) AS k, CASE WHEN x.page IS NOT NULL THEN 'relevant' ELSE 'irrelevant' END AS v FROM i0),
        last AS (SELECT query_id, k, arg_max(v, pos) AS v FROM i WHERE k IS NOT NULL GROUP BY ALL),
        m AS (SELECT c.*, last.v AS named, count(*) OVER (PARTITION BY c.query_id) AS n, count(last.v) OVER (PARTITION BY c.query_id) AS met
            FROM c LEFT JOIN last ON c.query_id = last.query_id AND lower(trim(c.chunk_id)) = last.k),
        t AS (SELECT query_id, count(*) AS n_items FROM i GROUP BY 1),
        f AS (SELECT m.query_id, m.pos, m.chunk_id, coalesce(named, CASE WHEN met = 0 AND n = n_items THEN i.v END) AS v
            FROM m LEFT JOIN t USING (query_id) LEFT JOIN i ON i.query_id = m.query_id AND i.pos = m.pos)
        SELECT query_id, pos, chunk_id, coalesce(v, 'ambiguous') AS verdict, CAST(CASE WHEN v IS NULL THEN 0.5 ELSE 0.9 END AS DOUBLE) AS score FROM f""",
    "route_decisions": f"""WITH {_S}, t AS (SELECT sample_id, coalesce(len(citations), 0) AS a, coalesce(retry_count, 0) AS r, coalesce(len(contexts), 0) AS e, sample_id % 2 AS hop FROM s)
        SELECT sample_id, CASE WHEN a = 0 AND r < {corrective.MAX_RETRIES} THEN 'rewrite' WHEN a = 0 AND e = 0 THEN 'aggregate'
            WHEN hop + 1 < {corrective.MAX_HOPS} THEN 'advance' ELSE 'aggregate' END AS next_step FROM t""",
    "distinct_evidence": f"""WITH {_S}, e AS (SELECT sample_id AS query_id, unnest(citations) AS c, generate_subscripts(citations, 1) - 1 AS pos FROM s)
        SELECT query_id, pos, c.chunk_id, c.section FROM (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(c.chunk_id, '') ORDER BY pos) AS nth FROM e) WHERE nth = 1""",
    "plain_answers": f"""WITH {_HITS}, e AS (SELECT query_id, rank - 1 AS pos, coalesce(text, '') AS context FROM hits JOIN corpus USING (chunk_id) WHERE rank <= {retrieval.SETTINGS.answer_contexts}),
        w AS (SELECT *, greatest({retrieval.SETTINGS.answer_characters} - coalesce(sum(length(context)) OVER p, 0), 0) AS room, coalesce(max(CAST(context = '' AS INTEGER)) OVER p, 0) AS gap FROM e
            WINDOW p AS (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        k AS (SELECT query_id, pos, substring(context, 1, CAST(room AS BIGINT)) AS context FROM w WHERE gap = 0 AND context <> '' AND room > 0),
        j AS (SELECT query_id, count(*) AS n_contexts, CAST(sum(length(context)) AS BIGINT) AS n_chars, arg_min(context, pos) AS first FROM k GROUP BY query_id)
        SELECT query_id, CASE WHEN n_contexts > 0 THEN 'answer' ELSE 'abstain' END AS status, CASE WHEN n_contexts > 0 THEN substring(first, 1, 200) ELSE {O.quoted(corrective.ABSTENTION)} END AS answer,
            coalesce(n_contexts, 0) AS n_contexts, coalesce(n_chars, 0) AS n_chars FROM q LEFT JOIN j USING (query_id)""",
}
QUERIES = {
    f.__name__: f
    for f in (
        graded_candidates, debug_projection, classified_questions, decomposed_questions, chunk_citations, verdict_join, route_decisions,
        distinct_evidence, validation_outcomes, plain_answers, corrective_loop,
    )
}
