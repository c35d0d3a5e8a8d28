"""Readers and writers: JSON lines with rejects, page files, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quarrylight.functions import text as T
from quarrylight.operators.runs import report_columns

DOCUMENT = (
    "doc_id string, doc_name string, company string, ticker string, doc_type string, document_type string, fiscal_year string, "
    "doc_period string, year string, source_path string, source_url string, doc_link string, url string, num_pages int"
)
QUESTION = (
    "financebench_id string, question_id string, company string, doc_name string, question_type string, question string, answer string, "
    "justification string, evidence array<struct<doc_name:string,evidence_page_num:string,evidence_text:string>>"
)
REPORT = (
    "question_id string, question string, status string, gold_answer string, predicted_answer string, citation_coverage double, citation_validity double, "
    "faithfulness double, answer_relevancy double, answer_correctness double, context_precision double, context_recall double, latency_ms double, "
    "retry_count int, error string"
)
PAGE = "page int, text string, tables array<string>"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected lines of a JSON lines file or folder; blank lines are skipped, a missing file is empty."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)
    lines = (spark.read.text(path) if known else spark.createDataFrame([], "value string")).filter(F.trim("value") != "")
    full = f"{schema}, _corrupt_record string"
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = parsed.filter(F.col("r._corrupt_record").isNull() & F.startswith(F.ltrim("value"), F.lit("{")))
    bad = parsed.filter(F.col("r._corrupt_record").isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{")))
    return good.select("r.*").drop("_corrupt_record"), bad.select("value")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document metadata under any of its column names, the first line of each id; rows without an id are dropped."""
    rows, _ = read_json_lines(spark, path, DOCUMENT)
    rows = rows.withColumn("line", F.monotonically_increasing_id())
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])
    return rows.select(
        first("doc_id", "doc_name").alias("doc_id"),
        "company",
        "ticker",
        first("doc_type", "document_type").alias("doc_type"),
        first("fiscal_year", "doc_period", "year").try_cast("int").alias("fiscal_year"),
        "source_path",
        first("source_url", "doc_link", "url").alias("source_url"),
        "num_pages",
        F.row_number().over(W.partitionBy(first("doc_id", "doc_name")).orderBy("line")).alias("nth"),
    ).filter(F.col("doc_id").isNotNull() & (F.col("nth") == 1)).drop("nth")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with evidence; unreadable pages are null, missing texts empty."""
    rows, _ = read_json_lines(spark, path, QUESTION)
    evidence = F.transform(
        "evidence",
        lambda e: F.struct(
            e["doc_name"].alias("doc_name"),
            e["evidence_page_num"].try_cast("int").alias("evidence_page_num"),
            F.coalesce(e["evidence_text"], F.lit("")).alias("evidence_text"),
        ),
    )
    return rows.filter(F.col("question").isNotNull()).select(
        F.coalesce("financebench_id", "question_id").alias("financebench_id"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("company", "doc_name", "question_type", "question", "answer", "justification")],
        F.coalesce(evidence, F.expr("CAST(array() AS array<struct<doc_name:string,evidence_page_num:int,evidence_text:string>>)")).alias("evidence"),
    )


def read_pages(spark: SparkSession, path: str, parse) -> DataFrame:
    """Pages of binary documents by a pluggable ``parse(bytes) -> [(page, text, tables), ...]``.

    A document that cannot be parsed gives one row with the ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"path": pa.string(), "error": pa.string(), "page": pa.int32(), "text": pa.string(), "tables": pa.list_(pa.string())})
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += [{"path": name, "page": n, "text": text, "tables": tables} for n, text, tables in parse(content)]
                except Exception as problem:  # noqa: BLE001 - errors are data
                    rows.append({"path": name, "error": str(problem)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, error string, {PAGE}")


def write_report(samples: DataFrame, folder: str) -> None:
    """The samples as JSON and, in the report's columns and rounding, as CSV with a header."""
    samples.write.mode("overwrite").json(f"{folder}/samples.json")
    report_columns(samples).drop("sample_id").write.mode("overwrite").option("header", True).csv(f"{folder}/samples.csv")


def write_manifest(manifest: DataFrame, folder: str) -> None:
    """Keeps the fingerprints of an ingest, in place of those before."""
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The fingerprints of the ingest before, or none (in the columns of ``like``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{folder}/manifest") if known else like.limit(0)


def write_chunk_cache(chunks: DataFrame, folder: str) -> None:
    """Chunks by filing, each filing under its cache name; what other filings have there stays."""
    named = chunks.withColumn("cache", T.cache_name(F.col("doc_id")))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache").parquet(folder)


def read_chunk_cache(spark: SparkSession, folder: str, documents: DataFrame) -> DataFrame:
    """The cached chunks of the documents (``doc_id``)."""
    names = documents.select(T.cache_name(F.col("doc_id")).alias("cache")).distinct()
    return spark.read.parquet(folder).join(names, "cache", "left_semi").drop("cache")


def read_report(spark: SparkSession, folder: str, schema: S.StructType) -> DataFrame:
    """The samples of a report written before."""
    return spark.read.schema(schema).json(f"{folder}/samples.json")


def console_report(metrics: DataFrame) -> str:
    """Lines ``name: value`` of a small table ``(metric, value)``, sorted by name; null reads n/a.

    The table has one row per metric, so it is bounded by the number of metrics.
    """
    rows = metrics.orderBy("metric").collect()
    return "\n".join(f"{r['metric']}: {'n/a' if r['value'] is None else format(r['value'], '.3f')}" for r in rows)
