"""Registered round trips: tables written by the sinks and read again by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import filings, lexical
from quarrylight.plans import evaluation, ingest, retrieval
from quarrylight.plans import oracle as O
from quarrylight.session import shared_folder, table
from quarrylight.sources import files, vector_store


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def documents_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings written as JSON lines under the fields' other names, between blank and broken lines, and read again."""
    d = filings.first_documents(table(spark, sf_dir, "doc_info"))
    line = F.to_json(
        F.struct(
            F.col("doc_id").alias("doc_name"), "company", "ticker", F.col("doc_type").alias("document_type"),
            F.col("fiscal_year").cast("string").alias("doc_period"), "source_path", F.col("source_url").alias("doc_link"), "num_pages",
        )
    )
    noise = F.explode(F.array(line, F.lit(""), F.concat(F.lit("broken "), line), F.substring(line, 1, 30)))
    folder = _folder(spark, "documents")
    d.select(noise.alias("value")).write.text(folder)
    return files.read_documents(spark, folder).select("doc_id", "company", "ticker", "doc_type", "fiscal_year", "source_url", "num_pages")


def json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader of JSON lines gives and what it rejects, of lines of which some are broken."""
    lines = table(spark, sf_dir, "doc_info").select(F.explode(F.array(F.to_json(F.struct("doc_id")), F.lit(" "), F.concat(F.lit("x"), "doc_id"))).alias("value"))
    folder = _folder(spark, "lines")
    lines.filter("value IS NOT NULL").write.text(folder)
    good, bad = files.read_json_lines(spark, folder, files.DOCUMENT)
    none, _ = files.read_json_lines(spark, folder + "-missing", files.DOCUMENT)
    count = lambda rows, kind: rows.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return count(good, "good").unionByName(count(bad, "rejected")).unionByName(count(none, "missing file"))


def questions_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions written as JSON lines and read again: missing texts are empty, pages numbers or null."""
    q = table(spark, sf_dir, "questions").filter(F.col("financebench_id").isNotNull()).dropDuplicates(["financebench_id"])
    folder = _folder(spark, "questions")
    q.select(F.to_json(F.struct(*q.columns)).alias("value")).write.text(folder)
    pages = F.array_join(F.transform("evidence", lambda e: F.coalesce(e["evidence_page_num"].cast("string"), F.lit("?"))), ",")
    size = F.aggregate("evidence", F.lit(0), lambda a, e: a + F.length(e["evidence_text"]))
    return files.read_questions(spark, folder).select("financebench_id", "question", "answer", "justification", pages.alias("pages"), size.alias("evidence_chars"))


def report_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written report read again: from its JSON the samples, from its table the rounded rates."""
    s = table(spark, sf_dir, "eval_samples").filter(F.col("sample_id").isNotNull()).dropDuplicates(["sample_id"])
    folder = _folder(spark, "report")
    files.write_report(s, folder)
    back = files.read_report(spark, folder, s.schema)
    flat = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").schema(files.REPORT).csv(f"{folder}/samples.csv")
    one = back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("retrieved_chunk_ids")).alias("n_chunks"))
    two = flat.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("citation_coverage"), 4).alias("coverage"), F.round(F.sum("latency_ms"), 1).alias("latency"))
    return one.join(two)  # one row each


def index_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and weights of the lexical index after it was kept and read again."""
    folder = _folder(spark, "kept-index")
    retrieval.index(spark, sf_dir).write(folder)
    index = lexical.Index.read(spark, folder)
    terms = index.idf.agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("idf"), 4).alias("weight"))
    return index.rows.agg(F.count(F.lit(1)).alias("n")).join(terms).withColumn("avgdl", F.round(F.lit(index.avgdl), 6))  # one row each


def vector_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of vectors created, filled, partly replaced by id and read again, by model."""
    v = table(spark, sf_dir, "chunk_vectors").filter(F.col("chunk_id").isNotNull())
    one = v.groupBy("chunk_id").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("v")).select("chunk_id", "v.*", F.lit("first").alias("model"))
    store = vector_store.Collection(spark, _folder(spark, "vectors"))
    store.create()
    store.upsert(one)
    store.upsert(one.filter(F.col("vec_id") % 3 == 0).withColumn("model", F.lit("second")))
    return store.rows().groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("n_ids"))


_S = evaluation._S
SQL = {
    "documents_from_json": f"WITH {ingest._FIRST} SELECT doc_id, company, ticker, doc_type, fiscal_year, nullif(trim(source_url), '') AS source_url, num_pages FROM first",
    "json_rejects": """SELECT 'good' AS kind, count(*) AS n FROM doc_info UNION ALL SELECT 'rejected', count(doc_id) FROM doc_info UNION ALL SELECT 'missing file', 0""",
    "questions_from_json": """WITH q AS (SELECT DISTINCT ON (financebench_id) * FROM questions WHERE financebench_id IS NOT NULL ORDER BY financebench_id)
        SELECT financebench_id, question, coalesce(answer, '') AS answer, coalesce(justification, '') AS justification,
            array_to_string(list_transform(coalesce(evidence, []), lambda e: coalesce(CAST(e.evidence_page_num AS VARCHAR), '?')), ',') AS pages,
            CAST(coalesce(list_sum(list_transform(evidence, lambda e: length(coalesce(e.evidence_text, '')))), 0) AS INTEGER) AS evidence_chars FROM q WHERE question IS NOT NULL""",
    "report_read_back": f"""WITH {_S} SELECT count(*) AS n, CAST(sum(len(retrieved_chunk_ids)) AS BIGINT) AS n_chunks, count(*) AS n_rows, round(sum(round(citation_coverage, 4)), 4) AS coverage,
        round(sum(round(latency_ms, 1)), 1) AS latency FROM s""",
    "index_read_back": f"WITH {O.CORPUS}, {O.INDEX} SELECT any_value(n) AS n, round(any_value(avgdl), 6) AS avgdl, count(*) AS n_terms, round(sum(idf), 4) AS weight FROM idfs, stats",
    "vector_collection": """WITH v AS (SELECT chunk_id, min(vec_id) AS vec_id FROM chunk_vectors WHERE chunk_id IS NOT NULL GROUP BY chunk_id)
        SELECT CASE WHEN vec_id % 3 = 0 THEN 'second' ELSE 'first' END AS model, count(*) AS n, count(DISTINCT chunk_id) AS n_ids FROM v GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (documents_from_json, json_rejects, questions_from_json, report_read_back, index_read_back, vector_collection)}
