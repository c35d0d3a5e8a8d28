"""Registered queries of evaluation runs: selection, keys, judging, second pass and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import citations, filings, runs
from quarrylight.plans import evaluation
from quarrylight.plans import oracle as O
from quarrylight.plans import retrieval
from quarrylight.session import materialise, table

METRICS = evaluation.METRICS


def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions, each id once, with their gold keys."""
    q = table(spark, sf_dir, "questions").filter(F.col("financebench_id").isNotNull()).dropDuplicates(["financebench_id"])
    return runs.with_gold(q)


def question_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of one type with gold documents, of companies that have chunks, on documents that another type asks about too."""
    q = question_rows(spark, sf_dir)
    companies = table(spark, sf_dir, "chunks").select("company")
    known = q.filter("question_type <> 'metrics-generated'").select(F.explode("doc_keys").alias("key"))
    kept = runs.filter_questions(q, "metrics-generated", companies, known)
    return kept.select("financebench_id", F.array_join("doc_keys", ",").alias("doc_keys"))


def numbered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of each selected question: its id, or its place in the selection where the id is blank (here every tenth)."""
    q = question_rows(spark, sf_dir).filter(F.size("doc_keys") > 0)
    blank = F.regexp_extract("financebench_id", "([0-9]+)", 1).cast("int") % 10 == 0
    keyed = runs.numbered(q.select("financebench_id", F.when(~blank, F.col("financebench_id")).otherwise("").alias("own")), "financebench_id")
    return keyed.select("financebench_id", runs.question_key(F.col("own"), F.col("place")).alias("question_key"))


def normalized_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as requests: blanks collapsed, a blank question is an error, a blank company none."""
    q = table(spark, sf_dir, "eval_samples").select("sample_id", "question", F.try_element_at("citations", F.lit(1))["company"].alias("company")).dropDuplicates(["sample_id"])
    text, company = T.collapsed(F.col("question")), F.nullif(T.collapsed(F.col("company")), F.lit(""))
    error = F.when(F.coalesce(text, F.lit("")) == "", "Question must not be blank")
    return q.filter("sample_id IS NOT NULL").select("sample_id", F.nullif(text, F.lit("")).alias("question"), company.alias("company"), error.alias("error"))


def sample_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and page keys of what was retrieved, or where nothing was, of what was cited."""
    s = runs.with_keys(evaluation.samples(spark, sf_dir))
    shown = [F.array_join(c, ",").alias(c) for c in ("doc_keys", "page_keys", "chunk_ids")]
    return s.select("sample_id", *shown, F.size("key_index").alias("n_index"), F.size("kept_contexts").alias("n_contexts"))


def chunk_doc_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document keys read from chunk ids, with the number of chunks."""
    keys = retrieval.docs(spark, sf_dir).select(T.doc_key_of_chunk(F.col("chunk_id")).alias("doc_key"))
    return keys.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n"))


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample as a run records it: failures as data, citation metrics for answers only."""
    s = evaluation.samples(spark, sf_dir)
    both = citations.coverage(s).join(citations.validity(s), "sample_id")
    failed = F.coalesce(F.trim("error"), F.lit("")) != ""
    blank = F.coalesce(T.collapsed(F.col("question")), F.lit("")) == ""
    status = F.when(failed | blank, "error").otherwise(F.col("status"))
    error = F.when(failed, F.trim("error")).when(blank, "Question must not be blank").otherwise("")
    rows = s.join(both, "sample_id").withColumn("state", status)
    metric = lambda c: F.round(F.when(F.col("state") == "answer", F.col(c)).otherwise(0.0), 6).alias(c)
    return rows.select("sample_id", F.col("state").alias("status"), error.alias("error"), metric("coverage"), metric("validity"))


def judged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorable samples with the judge's last row for their question; NaN scores count as none."""
    s = evaluation.samples(spark, sf_dir)
    judge = s.filter(F.col("generation").isNotNull()).select("question_id", F.struct("created_at", "sample_id").alias("turn"), "generation.*")
    scorable = s.filter((F.col("status") == "answer") & F.col("answer").rlike(r"\S") & (F.size("contexts") > 0)).select("sample_id", "question_id")
    return runs.judged(scorable, judge, METRICS).select("sample_id", *[F.round(m, 6).alias(m) for m in METRICS])


def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checkpoint of a first pass, judged again for the selected questions, with their references; nothing is generated anew."""
    checkpoint = materialise(evaluation.samples(spark, sf_dir).select("sample_id", "question_id", "status", "answer"), "first-pass")
    selected = question_rows(spark, sf_dir).filter(F.size("doc_keys") > 0)
    rows = runs.second_pass(checkpoint, selected)
    return rows.select("sample_id", "question_id", "status", "reference", F.size("reference_contexts").alias("n_contexts"))


def unsupported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the run names that name no family of metrics."""
    asked = evaluation.samples(spark, sf_dir).select(F.explode(F.split(F.lower("run_id"), "_")).alias("name")).filter("name <> ''")
    return runs.unsupported(asked, runs.FAMILIES)


def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics by level, page recall also under its usual name, and the number of scored samples."""
    doc, page = evaluation.doc_metrics_mean(spark, sf_dir), evaluation.page_metrics_mean(spark, sf_dir)
    names = [c for c in doc.columns if c != "n_scored"]
    rows = doc.unpivot("n_scored", names, "metric", "value").withColumn("level", F.lit("doc"))
    pages = page.unpivot("n_scored", names, "metric", "value").withColumn("level", F.lit("page"))
    alias = pages.filter(F.startswith("metric", F.lit("recall_"))).withColumn("metric", F.concat(F.lit("page_"), "metric"))
    # the count is that of samples with gold documents at both levels
    scored = doc.select(F.col("n_scored").alias("n"))
    return rows.unionByName(pages).unionByName(alias).join(F.broadcast(scored)).select("level", "metric", "value", F.col("n").alias("n_scored"))  # one row


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples as the report's table lists them."""
    return runs.report_columns(evaluation.samples(spark, sf_dir)).withColumn("sample_id", F.col("sample_id"))


def documents_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings named by the samples' gold keys, found by their normalised name."""
    named = evaluation.samples(spark, sf_dir).select(F.explode("gold_doc_keys").alias("key")).distinct()
    docs = filings.first_documents(table(spark, sf_dir, "doc_info")).withColumn("key", T.doc_key(F.col("doc_id")))
    return named.join(docs, "key", "left").select("key", "doc_id", "company", "doc_type", "fiscal_year")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the metadata of their filing."""
    info = filings.first_documents(table(spark, sf_dir, "doc_info")).select("doc_id", F.col("company").alias("filer"), F.col("doc_type").alias("form"), "num_pages")
    return retrieval.docs(spark, sf_dir).select("chunk_id", "doc_id").join(info, "doc_id", "left")


def last_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict that a rewriting of the query would be told: the last one of each candidate list."""
    from quarrylight.plans import answering

    rows = answering.verdict_join(spark, sf_dir)
    return rows.groupBy("query_id").agg(F.max_by("verdict", "pos").alias("verdict"), F.max_by("score", "pos").alias("score"))


_S = evaluation._S
_GOLD = f"""g0 AS (SELECT DISTINCT ON (financebench_id) * FROM questions WHERE financebench_id IS NOT NULL ORDER BY financebench_id),
g1 AS (SELECT *, list_filter(list_transform(coalesce(evidence, []), lambda e: coalesce(nullif(e.doc_name, ''), doc_name, '')), lambda n: n <> '') AS names FROM g0),
g2 AS (SELECT *, CASE WHEN len(names) > 0 THEN list_transform(names, lambda n: {O.doc_key("n")}) WHEN coalesce(doc_name, '') <> '' THEN [{O.doc_key("doc_name")}] ELSE [] END AS all_keys FROM g1),
gold AS (SELECT *, list_filter(all_keys, lambda v, i: list_position(all_keys, v) = i) AS doc_keys FROM g2)"""
_INT = "CAST(regexp_extract(financebench_id, '([0-9]+)', 1) AS INTEGER)"
_COLLAPSED = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_Q = _COLLAPSED.format(x="question")
_CITE_DOC = O.doc_key("c.filing")
_CITE_KEY = f"{_CITE_DOC} || '#p' || coalesce(CAST(c.page AS VARCHAR), '?')"
_CLEAN = ", ".join(f"round(CASE WHEN NOT isnan(g.{m}) THEN g.{m} END, 6) AS {m}" for m in METRICS)
SQL = {
    "question_selection": f"""WITH {_GOLD}, known AS (SELECT DISTINCT unnest(doc_keys) AS key FROM gold WHERE question_type <> 'metrics-generated')
        SELECT financebench_id, array_to_string(doc_keys, ',') AS doc_keys FROM gold WHERE question_type = 'metrics-generated' AND len(doc_keys) > 0
            AND lower(company) IN (SELECT lower(company) FROM chunks WHERE company IS NOT NULL) AND EXISTS (SELECT 1 FROM known WHERE list_contains(doc_keys, key))""",
    "numbered_questions": f"""WITH {_GOLD}, p AS (SELECT financebench_id, row_number() OVER (ORDER BY financebench_id) - 1 AS place FROM gold WHERE len(doc_keys) > 0)
        SELECT financebench_id, CASE WHEN {_INT} % 10 = 0 THEN 'q' || lpad(CAST(place AS VARCHAR), 4, '0') ELSE financebench_id END AS question_key FROM p""",
    "normalized_requests": f"""WITH r AS (SELECT DISTINCT ON (sample_id) sample_id, question, citations[1].company AS company FROM eval_samples WHERE sample_id IS NOT NULL ORDER BY sample_id)
        SELECT sample_id, nullif({_Q}, '') AS question, nullif({_COLLAPSED.format(x="company")}, '') AS company,
            CASE WHEN coalesce({_Q}, '') = '' THEN 'Question must not be blank' END AS error FROM r""",
    "sample_keys": f"""WITH {_S}, k AS (SELECT sample_id, len(list_filter(retrieved_chunk_ids, lambda x: x IS NOT NULL)) > 0 AS own, retrieved_doc_keys, retrieved_page_keys, retrieved_chunk_ids, chunk_key_index, contexts,
            coalesce(citations, []) AS cs FROM s)
        SELECT sample_id, array_to_string(CASE WHEN own THEN coalesce(retrieved_doc_keys, []) ELSE list_transform(cs, lambda c: {_CITE_DOC}) END, ',') AS doc_keys,
            array_to_string(CASE WHEN own THEN coalesce(retrieved_page_keys, []) ELSE list_transform(cs, lambda c: {_CITE_KEY}) END, ',') AS page_keys,
            array_to_string(CASE WHEN own THEN retrieved_chunk_ids ELSE list_transform(cs, lambda c: c.chunk_id) END, ',') AS chunk_ids,
            CASE WHEN own THEN coalesce(cardinality(chunk_key_index), 0) ELSE len(list_distinct(list_filter(list_transform(cs, lambda c: c.chunk_id), lambda x: x <> ''))) END AS n_index,
            len(list_filter(CASE WHEN len(contexts) > 0 THEN contexts ELSE list_transform(cs, lambda c: c.text_snippet) END, lambda x: x <> '')) AS n_contexts FROM k""",
    "chunk_doc_keys": f"""WITH {O.CORPUS}, k AS (SELECT regexp_replace(chunk_id, '_p[0-9]{{1,4}}(_[\\s\\S]*)?$', '') AS stem FROM corpus)
        SELECT {O.doc_key("stem")} AS doc_key, count(*) AS n FROM k GROUP BY 1""",
    "run_rows": f"""WITH s AS (SELECT DISTINCT ON (sample_id) * REPLACE (lower(trim(status)) AS status), predicted_answer AS answer FROM eval_samples WHERE sample_id IS NOT NULL ORDER BY sample_id),
        a AS (SELECT * FROM s), {evaluation._COVER}, {evaluation._VALID},
        r AS (SELECT sample_id, CASE WHEN coalesce(trim(error), '') <> '' OR coalesce({_Q}, '') = '' THEN 'error' ELSE status END AS status,
            CASE WHEN coalesce(trim(error), '') <> '' THEN trim(error) WHEN coalesce({_Q}, '') = '' THEN 'Question must not be blank' ELSE '' END AS error, coverage, validity
            FROM s JOIN coverage USING (sample_id) JOIN validity USING (sample_id))
        SELECT sample_id, status, error, round(CASE WHEN status = 'answer' THEN coverage ELSE 0.0 END, 6) AS coverage, round(CASE WHEN status = 'answer' THEN validity ELSE 0.0 END, 6) AS validity FROM r""",
    "judged_samples": f"""WITH {_S}, j AS (SELECT question_id, arg_max(generation, (created_at, sample_id)) AS g FROM s WHERE generation IS NOT NULL GROUP BY question_id)
        SELECT sample_id, {_CLEAN} FROM a LEFT JOIN j USING (question_id) WHERE regexp_matches(answer, '\\S') AND len(contexts) > 0""",
    "second_pass": f"""WITH {_S}, {_GOLD} SELECT sample_id, question_id, status, coalesce(gold.answer, '') AS reference,
            len(list_filter(coalesce(evidence, []), lambda e: coalesce(e.evidence_text, '') <> '')) AS n_contexts
        FROM s JOIN gold ON question_id = financebench_id WHERE len(doc_keys) > 0""",
    "unsupported_names": f"""WITH {_S}, n AS (SELECT DISTINCT unnest(string_split(lower(run_id), '_')) AS name FROM s) SELECT name FROM n WHERE name <> '' AND name NOT IN ({", ".join(map(O.quoted, runs.FAMILIES))})""",
    "retrieval_report": f"""WITH d AS (WITH {evaluation._DOC} SELECT {evaluation._MEANS} FROM m), p AS (WITH {evaluation._PAGE} SELECT {evaluation._MEANS} FROM m),
        u AS (SELECT 'doc' AS level, metric, value FROM (UNPIVOT (SELECT * EXCLUDE n_scored FROM d) ON COLUMNS(*) INTO NAME metric VALUE value)
            UNION ALL SELECT 'page', metric, value FROM (UNPIVOT (SELECT * EXCLUDE n_scored FROM p) ON COLUMNS(*) INTO NAME metric VALUE value))
        SELECT level, metric, value, (SELECT n_scored FROM d) AS n_scored FROM u
        UNION ALL SELECT level, 'page_' || metric, value, (SELECT n_scored FROM d) FROM u WHERE level = 'page' AND starts_with(metric, 'recall_')""",
    "report_rows": f"""WITH {_S} SELECT sample_id, question_id, question, status, gold_answer, predicted_answer, round(citation_coverage, 4) AS citation_coverage, round(citation_validity, 4) AS citation_validity,
        {", ".join(f"generation.{m} AS {m}" for m in METRICS)}, round(latency_ms, 1) AS latency_ms, retry_count, error FROM s""",
    "documents_by_name": f"""WITH {_S}, {{first}}, n AS (SELECT DISTINCT unnest(gold_doc_keys) AS key FROM s) SELECT key, doc_id, company, doc_type, fiscal_year
        FROM n LEFT JOIN first ON {O.doc_key("doc_id")} = key""",
    "chunk_documents": f"""WITH {O.CORPUS}, {{first}} SELECT chunk_id, c.doc_id, f.company AS filer, f.doc_type AS form, f.num_pages FROM corpus c LEFT JOIN first f ON f.doc_id = c.doc_id""",
    "last_verdicts": """WITH v AS ({verdicts}) SELECT query_id, arg_max(verdict, pos) AS verdict, arg_max(score, pos) AS score FROM v GROUP BY query_id""",
}


def _filled() -> None:
    from quarrylight.plans import answering, ingest

    for name in ("documents_by_name", "chunk_documents"):
        SQL[name] = SQL[name].replace("{first}", ingest._FIRST)
    SQL["last_verdicts"] = SQL["last_verdicts"].replace("{verdicts}", answering.SQL["verdict_join"])


_filled()
QUERIES = {
    f.__name__: f
    for f in (
        question_selection, numbered_questions, normalized_requests, sample_keys, chunk_doc_keys, run_rows, judged_samples, second_pass,
        unsupported_names, retrieval_report, report_rows, documents_by_name, chunk_documents, last_verdicts,
    )
}
