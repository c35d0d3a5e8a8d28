"""Registered evaluation queries over the samples of evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import citations, metrics, runs
from quarrylight.plans import oracle as O
from quarrylight.session import table
from quarrylight.settings import Settings

METRICS = ["faithfulness", "answer_relevancy", "answer_correctness", "context_precision", "context_recall"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples, each id once; the status without stray case and blanks."""
    rows = table(spark, sf_dir, "eval_samples").filter(F.col("sample_id").isNotNull()).dropDuplicates(["sample_id"])
    return rows.withColumn("status", F.lower(F.trim("status"))).withColumn("answer", F.col("predicted_answer"))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).filter(F.col("status") == "answer")


def doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sample_metrics(samples(spark, sf_dir), "gold_doc_keys", "retrieved_doc_keys")


def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sample_metrics(samples(spark, sf_dir), "gold_page_keys", "retrieved_page_keys")


def doc_metrics_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_metrics(doc_metrics(spark, sf_dir))


def page_metrics_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_metrics(page_metrics(spark, sf_dir))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir).select("sample_id", F.posexplode(T.sentences(F.col("answer"))).alias("pos", "sentence"))


def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = answered(spark, sf_dir).select("sample_id", "citations", F.posexplode(T.markers(F.col("answer"))).alias("pos", "marker"))
    return each.select("sample_id", "pos", F.trim("marker").alias("marker"), citations.resolved(F.col("marker"), F.col("citations")).alias("place"))


def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = citations.coverage(answered(spark, sf_dir))
    return rows.select("sample_id", F.round("coverage", 6).alias("coverage"))


def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = citations.validity(answered(spark, sf_dir))
    return rows.select("sample_id", F.round("validity", 6).alias("validity"))


def citation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean coverage and validity over the answered samples; 0 without any."""
    a = answered(spark, sf_dir)
    both = citations.coverage(a).join(citations.validity(a), "sample_id")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return both.agg(F.count(F.lit(1)).alias("n"), mean("coverage"), mean("validity"))


def ops_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians over the answered, rates over all samples, per run and in total."""
    s = samples(spark, sf_dir)
    ok = F.col("status") == "answer"
    latency = F.when(ok & ~F.isnan("latency_ms"), F.col("latency_ms"))
    return s.rollup("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.median(latency), 6).alias("median_latency_ms"),
        F.round(F.median(F.when(ok, F.col("retry_count"))), 6).alias("median_retries"),
        F.round(F.avg((F.col("status") == "abstain").cast("double")), 6).alias("abstain_rate"),
        F.round(F.avg((F.col("status") == "error").cast("double")), 6).alias("error_rate"),
    )


def generation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the judged metrics without nulls and NaN; null where nothing is left."""
    s = samples(spark, sf_dir)
    scores = [F.round(F.avg(F.when(~F.isnan(f"generation.{m}"), F.col(f"generation.{m}"))), 6).alias(m) for m in METRICS]
    return s.agg(*scores)


def scorable_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered, with a non-blank answer and contexts."""
    rows = answered(spark, sf_dir).filter(F.col("answer").rlike(r"\S") & (F.size("contexts") > 0))
    return rows.select("sample_id", F.size("contexts").alias("n_contexts"))


def cleaned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir).filter(F.col("answer").isNotNull()).select("sample_id", T.cleaned_answer(F.col("answer")).alias("answer"))


def question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold document and page keys of each question, distinct, in order."""
    q = runs.with_gold(table(spark, sf_dir, "questions").filter(F.col("financebench_id").isNotNull()).dropDuplicates(["financebench_id"]))
    return q.select(
        "financebench_id",
        F.array_join("doc_keys", ",").alias("doc_keys"),
        F.array_join("page_keys", ",").alias("page_keys"),
        F.size(F.filter("evidence", lambda e: F.trim(F.coalesce(e["evidence_text"], F.lit(""))) != "")).alias("n_contexts"),
    )


def question_sample(spark: SparkSession, sf_dir: str, seed: int = 42, share: float = 0.2) -> DataFrame:
    """A seeded sample of the questions with gold documents: those first in the order of a hash."""
    q = question_keys(spark, sf_dir).filter(F.col("doc_keys") != "")
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("financebench_id")), 256), 1, 8)
    drawn = F.conv(digest, 16, 10).cast("bigint") < int(share * 2**32)
    return q.filter(drawn).select("financebench_id", "doc_keys")


def question_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of companies that have filings in the corpus, by type."""
    companies = table(spark, sf_dir, "chunks").filter(F.trim("company") != "").select(F.lower(F.trim("company")).alias("lc")).distinct()
    q = table(spark, sf_dir, "questions").select("financebench_id", "question_type", F.lower(F.trim("company")).alias("lc")).distinct()
    return q.join(companies, "lc", "left_semi").groupBy("question_type").agg(F.count(F.lit(1)).alias("n"))


def within_budget(contexts: DataFrame, key: str, budget: int) -> DataFrame:
    """The contexts ``(key, pos, context)`` that fit a budget of characters, each cut to what is left of it; an empty one ends the list."""
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    size = F.length(F.coalesce("context", F.lit("")))
    prior = F.coalesce(F.sum(size).over(w), F.lit(0))
    gap = F.coalesce(F.max((size == 0).cast("int")).over(w), F.lit(0))
    left = contexts.withColumn("room", F.greatest(F.lit(budget) - prior, F.lit(0))).withColumn("gap", gap).withColumn("size", size)
    kept = left.filter((F.col("gap") == 0) & (F.col("size") > 0) & (F.col("room") > 0))
    return kept.select(key, "pos", F.expr("substring(context, 1, CAST(room AS int))").alias("context"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first contexts of each sample within the budget of the settings."""
    s = Settings.from_environment()
    each = samples(spark, sf_dir).select("sample_id", F.posexplode(F.slice("contexts", 1, s.answer_contexts)).alias("pos", "context"))
    return within_budget(each, "sample_id", s.answer_characters)


def evidence_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contexts of a sample as one numbered text."""
    rows = samples(spark, sf_dir).filter(F.size("contexts") > 0)
    numbered = F.transform("contexts", lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(c, F.lit(""))))
    return rows.select("sample_id", F.array_join(numbered, "\n\n---\n\n").alias("evidence"))


def citation_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five citations of each sample with a snippet of 200 characters."""
    each = samples(spark, sf_dir).select("sample_id", F.posexplode(F.slice("citations", 1, 5)).alias("pos", "c"))
    return each.select("sample_id", "pos", "c.company", "c.filing", "c.page", "c.chunk_id", F.substring("c.text_snippet", 1, 200).alias("snippet"))


def retrieved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered page keys of the retrieved chunks that the sample's index knows, else its own list."""
    s = samples(spark, sf_dir)
    from_index = F.transform("retrieved_chunk_ids", lambda c: F.try_element_at("chunk_key_index", c))
    known = F.filter(from_index, lambda k: k.isNotNull())
    own = F.coalesce("retrieved_page_keys", F.expr("CAST(array() AS array<string>)"))
    return s.select("sample_id", F.array_join(F.when(F.size(known) > 0, known).otherwise(own), ",").alias("page_keys"))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per metric: name and value, sorted by name as a report lists them."""
    doc = doc_metrics_mean(spark, sf_dir).select("mrr", "recall_10", "ndcg_10", "hit_rate_10")
    cite = citation_means(spark, sf_dir).select("coverage", "validity")
    gen = generation_means(spark, sf_dir)
    wide = doc.join(cite).join(gen)  # one row each
    return wide.unpivot([], wide.columns, "metric", "value").orderBy("metric")


_S = """s AS (SELECT DISTINCT ON (sample_id) * REPLACE (lower(trim(status)) AS status), predicted_answer AS answer
    FROM eval_samples WHERE sample_id IS NOT NULL ORDER BY sample_id), a AS (SELECT * FROM s WHERE status = 'answer')"""
_SENT = """list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(answer, ''), '([.!?])\\s+([A-Z(\\[$])', '\\1' || chr(31) || '\\2', 'g'),
    '\\n+', chr(31), 'g'), chr(31)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"""


def _markers(x: str) -> str:
    inside = f"regexp_extract_all(coalesce({x}, ''), '\\[([^\\[\\]]{{1,120}})\\]', 1)"
    return f"list_filter(flatten(list_transform({inside}, lambda m: string_split_regex(m, '[;,]'))), lambda m: trim(m) <> '')"


def _place(m: str, c: str) -> str:
    t = f"trim(regexp_replace(regexp_replace(trim({m}), '^[\\^# ]+', ''), '^[cC]([0-9]+)$', '\\1'))"
    return f"""CASE WHEN regexp_matches({t}, '^[0-9]{{1,9}}$') THEN CASE WHEN CAST({t} AS BIGINT) BETWEEN 1 AND len({c}) THEN CAST({t} AS INTEGER) END
        WHEN {t} <> '' THEN list_position(list_transform({c}, lambda x: lower(x.chunk_id)), lower({t})) END"""


_NUM = f"len(list_filter({_SENT}, lambda x: regexp_matches(x, '[0-9]'))) > 0"
_COVER = f"""claims AS (SELECT sample_id, citations, unnest(CASE WHEN {_NUM} THEN list_filter({_SENT}, lambda x: regexp_matches(x, '[0-9]')) ELSE {_SENT} END) AS sentence FROM a),
hits AS (SELECT sample_id, sentence, citations, unnest({_markers("sentence")}) AS m, nth FROM (SELECT *, row_number() OVER () AS nth FROM claims)),
good AS (SELECT DISTINCT nth FROM hits WHERE {_place("m", "citations")} IS NOT NULL),
per AS (SELECT sample_id, avg(CASE WHEN nth IN (SELECT nth FROM good) THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT *, row_number() OVER () AS nth FROM claims) GROUP BY sample_id),
coverage AS (SELECT sample_id, coalesce(share, 0.0) AS coverage FROM a LEFT JOIN per USING (sample_id))"""
_VALID = f"""marks AS (SELECT a.*, unnest({_markers("answer")}) AS m FROM a),
places AS (SELECT DISTINCT ON (sample_id, place) *, {_place("m", "citations")} AS place FROM marks WHERE {_place("m", "citations")} IS NOT NULL ORDER BY sample_id, place),
named AS (SELECT DISTINCT ON (sample_id, c) *, citations[place] AS c FROM places ORDER BY sample_id, c),
keyed AS (SELECT *, coalesce(chunk_key_index[c.chunk_id], '') AS mapped FROM named),
parts AS (SELECT *, CASE WHEN mapped <> '' THEN split_part(mapped, '#p', 1) ELSE coalesce(nullif({O.doc_key("regexp_replace(coalesce(c.chunk_id, ''), '_p[0-9]{1,4}(_[\\s\\S]*)?$', '')")}, ''), {O.doc_key("c.filing")}) END AS doc,
    CASE WHEN mapped <> '' THEN split_part(mapped, '#p', 2) ELSE coalesce(CAST(c.page AS VARCHAR), '?') END AS pg FROM keyed),
judged AS (SELECT sample_id, NOT (
    coalesce(coalesce(c.chunk_id, '') <> '' AND len(list_filter(retrieved_chunk_ids, lambda x: x <> '')) > 0 AND NOT list_contains(retrieved_chunk_ids, c.chunk_id), false)
    OR coalesce(len(gold_doc_keys) > 0 AND doc <> '' AND NOT list_contains(gold_doc_keys, doc), false)
    OR coalesce(len(gold_page_keys) > 0 AND NOT list_contains(gold_page_keys, doc || '#p' || CASE WHEN pg = '' THEN '?' ELSE pg END), false)) AS ok FROM parts),
shares AS (SELECT sample_id, avg(CAST(ok AS INTEGER)) AS share FROM judged GROUP BY sample_id),
validity AS (SELECT sample_id, coalesce(share, 0.0) AS validity FROM a LEFT JOIN shares USING (sample_id))"""


def _metrics(gold: str, run: str) -> str:
    cols = ["round(coalesce(max(1.0 / rank), 0.0), 6) AS mrr"]
    for k in metrics.K_VALUES:
        n = f"count(rank) FILTER (rank <= {k})"
        ideal = f"list_sum(list_transform(range(1, CAST(least({k}, any_value(n_gold)) AS BIGINT) + 1), lambda r: 1.0 / log2(r + 1.0)))"
        cols += [
            f"round({n} / {k}.0, 6) AS precision_{k}",
            f"round({n} / any_value(n_gold), 6) AS recall_{k}",
            f"round(coalesce(sum(1.0 / log2(rank + 1.0)) FILTER (rank <= {k}), 0.0) / {ideal}, 6) AS ndcg_{k}",
            f"CAST({n} > 0 AS INTEGER)::DOUBLE AS hit_rate_{k}",
        ]
    return f"""{_S}, gold AS (SELECT DISTINCT sample_id, unnest({gold}) AS key FROM s),
        sized AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n_gold FROM gold WHERE key IS NOT NULL),
        run AS (SELECT sample_id, unnest({run}) AS key, generate_subscripts({run}, 1) AS pos FROM s),
        best AS (SELECT sample_id, key, min(pos) AS pos FROM run WHERE key IS NOT NULL GROUP BY ALL),
        ranks AS (SELECT sample_id, key, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS rank FROM best),
        m AS (SELECT sample_id, {", ".join(cols)} FROM sized LEFT JOIN ranks USING (sample_id, key) GROUP BY sample_id)"""


_NAMES = ["mrr"] + [f"{m}_{k}" for k in metrics.K_VALUES for m in ("precision", "recall", "ndcg", "hit_rate")]
_MEANS = "count(*) AS n_scored, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in _NAMES)
_DOC, _PAGE = _metrics("gold_doc_keys", "retrieved_doc_keys"), _metrics("gold_page_keys", "retrieved_page_keys")
_GEN = ", ".join(f"round(avg(generation.{m}) FILTER (NOT isnan(generation.{m})), 6) AS {m}" for m in METRICS)
_NAME = "coalesce(nullif(e.doc_name, ''), doc_name, '')"
_EV = f"list_filter(coalesce(evidence, []), lambda e: {_NAME} <> '')"
_FIRST = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_DOCS = f"list_transform({_EV}, lambda e: {O.doc_key(_NAME)})"
_PAGES = f"list_transform(list_filter({_EV}, lambda e: e.evidence_page_num IS NOT NULL), lambda e: {O.doc_key(_NAME)} || '#p' || (e.evidence_page_num + 1))"
_KEYS = f"""qk AS (SELECT financebench_id, doc_name, evidence, {_DOCS} AS ds, {_PAGES} AS ps FROM (
    SELECT DISTINCT ON (financebench_id) * FROM questions WHERE financebench_id IS NOT NULL ORDER BY financebench_id)),
keys AS (SELECT financebench_id, CASE WHEN len(ds) > 0 THEN array_to_string({_FIRST.format(x="ds")}, ',') ELSE {O.doc_key("doc_name")} END AS doc_keys,
    array_to_string({_FIRST.format(x="ps")}, ',') AS page_keys,
    len(list_filter(evidence, lambda e: trim(coalesce(e.evidence_text, '')) <> '')) AS n_contexts FROM qk)"""

SQL = {
    "doc_metrics": f"WITH {_DOC} SELECT * FROM m",
    "page_metrics": f"WITH {_PAGE} SELECT * FROM m",
    "doc_metrics_mean": f"WITH {_DOC} SELECT {_MEANS} FROM m",
    "page_metrics_mean": f"WITH {_PAGE} SELECT {_MEANS} FROM m",
    "sentence_split": f"WITH {_S} SELECT sample_id, unnest({_SENT}) AS sentence, generate_subscripts({_SENT}, 1) - 1 AS pos FROM a",
    "citation_markers": f"""WITH {_S}, e AS (SELECT sample_id, citations, unnest({_markers("answer")}) AS marker, generate_subscripts({_markers("answer")}, 1) - 1 AS pos FROM a)
        SELECT sample_id, pos, trim(marker) AS marker, {_place("marker", "citations")} AS place FROM e""",
    "citation_coverage": f"WITH {_S}, {_COVER} SELECT sample_id, round(coverage, 6) AS coverage FROM coverage",
    "citation_validity": f"WITH {_S}, {_VALID} SELECT sample_id, round(validity, 6) AS validity FROM validity",
    "citation_means": f"""WITH {_S}, {_COVER}, {_VALID} SELECT count(*) AS n, round(coalesce(avg(coverage), 0.0), 6) AS coverage,
        round(coalesce(avg(validity), 0.0), 6) AS validity FROM coverage JOIN validity USING (sample_id)""",
    "ops_stats": f"""WITH {_S} SELECT run_id, count(*) AS n,
        round(median(latency_ms) FILTER (status = 'answer' AND NOT isnan(latency_ms)), 6) AS median_latency_ms,
        round(median(retry_count) FILTER (status = 'answer'), 6) AS median_retries,
        round(avg(CAST(status = 'abstain' AS INTEGER)), 6) AS abstain_rate, round(avg(CAST(status = 'error' AS INTEGER)), 6) AS error_rate
        FROM s GROUP BY ROLLUP (run_id)""",
    "generation_means": f"WITH {_S} SELECT {_GEN} FROM s",
    "scorable_samples": f"WITH {_S} SELECT sample_id, len(contexts) AS n_contexts FROM a WHERE regexp_matches(answer, '\\S') AND len(contexts) > 0",
    "cleaned_answers": f"WITH {_S} SELECT sample_id, regexp_replace(regexp_replace(answer, '(?s)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS answer FROM a WHERE answer IS NOT NULL",
    "eval_report": f"""WITH {_DOC}, d AS (SELECT {_MEANS} FROM m), c1 AS (WITH {_S}, {_COVER}, {_VALID} SELECT round(coalesce(avg(coverage), 0.0), 6) AS coverage, round(coalesce(avg(validity), 0.0), 6) AS validity
            FROM coverage JOIN validity USING (sample_id)), g AS (SELECT {_GEN} FROM s)
        SELECT metric, value FROM (SELECT mrr, recall_10, ndcg_10, hit_rate_10, coverage, validity, {", ".join(METRICS)} FROM d, c1, g)
            UNPIVOT INCLUDE NULLS (value FOR metric IN (mrr, recall_10, ndcg_10, hit_rate_10, coverage, validity, {", ".join(METRICS)}))""",
    "question_keys": f"WITH {_KEYS} SELECT * FROM keys",
    "question_sample": f"""WITH {_KEYS} SELECT financebench_id, doc_keys FROM keys WHERE doc_keys <> ''
        AND CAST('0x' || substring(sha256('42:' || financebench_id), 1, 8) AS BIGINT) < {int(0.2 * 2**32)}""",
    "question_filter": """SELECT question_type, count(*) AS n FROM (SELECT DISTINCT financebench_id, question_type, lower(trim(company)) AS lc FROM questions)
        WHERE lc IN (SELECT lower(trim(company)) FROM chunks WHERE trim(company) <> '') GROUP BY question_type""",
    "context_budget": f"""WITH {_S}, e AS (SELECT sample_id, unnest(contexts[1:6]) AS context, generate_subscripts(contexts[1:6], 1) - 1 AS pos FROM s),
        w AS (SELECT *, greatest(1600 - coalesce(sum(length(coalesce(context, ''))) OVER p, 0), 0) AS room,
            coalesce(max(CAST(coalesce(context, '') = '' AS INTEGER)) OVER p, 0) AS gap FROM e
            WINDOW p AS (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT sample_id, pos, substring(context, 1, CAST(room AS BIGINT)) AS context FROM w WHERE gap = 0 AND length(context) > 0 AND room > 0""",
    "evidence_format": f"""WITH {_S} SELECT sample_id, array_to_string(list_transform(contexts, lambda c, i: '[' || i || '] ' || coalesce(c, '')), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS evidence
        FROM s WHERE len(contexts) > 0""",
    "citation_projection": f"""WITH {_S}, e AS (SELECT sample_id, unnest(citations[1:5]) AS c, generate_subscripts(citations[1:5], 1) - 1 AS pos FROM s)
        SELECT sample_id, pos, c.company, c.filing, c.page, c.chunk_id, substring(c.text_snippet, 1, 200) AS snippet FROM e""",
    "retrieved_keys": f"""WITH {_S}, k AS (SELECT sample_id, retrieved_page_keys, list_filter(list_transform(retrieved_chunk_ids, lambda c: chunk_key_index[c]), lambda x: x IS NOT NULL) AS known FROM s)
        SELECT sample_id, array_to_string(CASE WHEN len(known) > 0 THEN known ELSE coalesce(retrieved_page_keys, []) END, ',') AS page_keys FROM k""",
}
QUERIES = {
    f.__name__: f
    for f in (
        doc_metrics, page_metrics, doc_metrics_mean, page_metrics_mean, sentence_split, citation_markers, citation_coverage, citation_validity,
        citation_means, ops_stats, generation_means, scorable_samples, cleaned_answers, question_keys, question_sample, question_filter,
        context_budget, evidence_format, citation_projection, retrieved_keys, eval_report,
    )
}
