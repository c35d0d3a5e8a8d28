"""Document metadata, ingest state and chunk structure as table operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as T


def first_documents(rows: DataFrame) -> DataFrame:
    """One record per doc_id, the first loaded; defaults filled and the type canonical.

    Null ids are left out.  Ties of the load time go to the smaller source path
    and URL.  A blank company is 'Unknown'; a blank ticker is the company in
    upper case.
    """
    w = W.partitionBy("doc_id").orderBy("loaded_at", "source_path", "source_url", "company", "ticker", "doc_type", "fiscal_year", "num_pages")
    first = rows.filter(F.trim("doc_id") != "").withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    company = F.coalesce(F.nullif(F.trim("company"), F.lit("")), F.lit("Unknown"))
    ticker = F.coalesce(F.nullif(F.trim("ticker"), F.lit("")), F.upper(company))
    return first.select(
        "doc_id",
        company.alias("company"),
        ticker.alias("ticker"),
        T.doc_type(F.col("doc_type")).alias("doc_type"),
        "fiscal_year",
        F.coalesce("source_path", F.lit("")).alias("source_path"),
        F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.coalesce("num_pages", F.lit(0)).alias("num_pages"),
    )


def latest_state(log: DataFrame) -> DataFrame:
    """The last entry per doc_id of an ingest log (keep-latest upsert); ties by the larger row."""
    fields = [c for c in log.columns if c != "doc_id"]
    order = ["updated_at", *[c for c in fields if c != "updated_at"]]
    return (
        log.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.struct(*order)).alias("s"))
        .select("doc_id", *[F.col(f"s.{c}") for c in fields])
    )


def stale_documents(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc_id, reason)`` of the wanted documents that need (re-)parsing.

    ``wanted`` has ``doc_id, pdf_path, pdf_mtime_ns, chunk_size, chunk_overlap,
    parser_version``; a document is fresh if its last state is complete and
    equal in all of them (null-safe).
    """
    keys = ["pdf_path", "pdf_mtime_ns", "chunk_size", "chunk_overlap", "parser_version"]
    s = state.select("doc_id", "status", *[F.col(k).alias(f"s_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys))
    reason = F.when(F.col("status").isNull(), "new").when(F.col("status") != "complete", "failed").when(~same, "changed")
    return wanted.join(s, "doc_id", "left").select("doc_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def upsert(state: DataFrame, news: DataFrame) -> DataFrame:
    """The state after new entries: the later entry of each doc_id (files cannot be merged in place)."""
    return latest_state(state.unionByName(news))


#: Columns of the ingest state and their values where an older table lacks them.
STATE_DEFAULTS = {
    "pdf_path": ("string", ""), "pdf_mtime_ns": ("bigint", 0), "chunk_size": ("int", 0), "chunk_overlap": ("int", 0), "cache_path": ("string", ""),
    "status": ("string", ""), "chunk_count": ("bigint", 0), "error": ("string", ""), "parser_version": ("string", ""), "updated_at": ("double", 0.0),
}


def with_columns(rows: DataFrame, defaults: dict) -> DataFrame:
    """The rows with every missing column added at its default."""
    return rows.withColumns({c: F.lit(v).cast(kind) for c, (kind, v) in defaults.items() if c not in rows.columns})


def empty_state(spark) -> DataFrame:
    """A reset state: all columns, no row."""
    return with_columns(spark.createDataFrame([], "doc_id string"), STATE_DEFAULTS)


def manifest(chunks: DataFrame, group: str, settings_key: str) -> DataFrame:
    """``(group, fingerprint)``: digest of the settings and of the group's filings.

    Filings enter by the sum of their digests, a partial aggregate, so a group
    of any size is never brought together in one row.
    """
    ids = chunks.filter(F.col("chunk_id").isNotNull()).select(group, "doc_id").distinct()
    digest = F.conv(F.substring(F.md5("doc_id"), 1, 8), 16, 10).cast("bigint")
    sums = ids.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("s"))
    return sums.select(group, F.sha2(F.concat_ws("|", F.lit(settings_key), F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("fingerprint"))


def manifest_changes(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """``(group, rebuild)``: whether a group's stored fingerprint is missing or differs from the present one."""
    o = old.select(F.col(group).alias("g"), F.col("fingerprint").alias("before"))
    both = new.join(o, F.col(group).eqNullSafe(F.col("g")), "left")
    return both.select(group, (~F.col("fingerprint").eqNullSafe(F.col("before"))).alias("rebuild"))


def merged_chunks(cached: DataFrame, parsed: DataFrame) -> DataFrame:
    """Cached chunks (``origin`` 0) and newly parsed ones (1), with ``corpus_pos`` inside each filing by chunk id.

    The order of the corpus is (origin, doc_id, corpus_pos).
    """
    every = cached.withColumn("origin", F.lit(0)).unionByName(parsed.withColumn("origin", F.lit(1)))
    return every.withColumn("corpus_pos", F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_id")) - 1)


#: Fixed value: a company's name with its legal form on a first page.
COMPANY_NAME = r"\b([A-Z][A-Za-z0-9&.,'\- ]+?\s+(?:Inc\.|Corp\.|Corporation|Company|Ltd\.|plc))\b"


def file_documents(files: DataFrame, path: str, first_page: str) -> DataFrame:
    """``(doc_id, company, ticker, doc_type, fiscal_year, source_path)`` from file names and first pages.

    The name is read as ticker, year and type between underscores; without a
    year it is 2023, without a type 10-K; without a company on the first page
    it is the ticker.
    """
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    parts = F.split(F.replace(stem, F.lit(" "), F.lit("_")), "_")
    ticker = F.upper(F.element_at(parts, 1))
    year = F.nullif(F.regexp_extract(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), "[0-9]{4}", 0), F.lit(""))
    named = F.nullif(F.trim(F.regexp_extract(F.substring(first_page, 1, 2000), COMPANY_NAME, 1)), F.lit(""))
    return files.select(
        stem.alias("doc_id"),
        F.coalesce(named, ticker).alias("company"),
        ticker.alias("ticker"),
        F.coalesce(F.replace(F.try_element_at(parts, F.lit(3)), F.lit("-"), F.lit("_")), F.lit("10-K")).alias("doc_type"),
        F.coalesce(year, F.lit("2023")).cast("int").alias("fiscal_year"),
        F.col(path).alias("source_path"),
    )


def resolved_paths(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """``(doc_id, path, tier)``: the file of each document.

    Tiers: 1 the stem is the id, 2 the normalised stem is, 3 the stem spells
    ticker or company, year and type, 4 the stem has tokens for all three.
    The lowest tier wins, then the first path by name.  Tier 4 meets over the
    year token.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
    files = paths.select("path").distinct().withColumn("stem", stem).filter(F.col("stem") != "")
    files = files.withColumn("norm", T.doc_key(F.col("stem"))).withColumn(
        "tokens", F.array_distinct(F.filter(F.transform(F.split("stem", "[_-]+"), lambda t: T.doc_key(t)), lambda t: t != ""))
    )
    d = documents.select("doc_id", "ticker", "company", T.doc_key(F.col("doc_type")).alias("kind"), F.col("fiscal_year").cast("string").alias("year"))
    aliases = F.when(F.col("kind").isin("10kannual", "10kannualreport"), F.array("kind", F.lit("annualreport"))).otherwise(F.array("kind"))
    one = d.join(files, F.col("doc_id") == F.col("stem")).select("doc_id", "path", F.lit(1).alias("tier"))
    two = d.join(files, T.doc_key(F.col("doc_id")) == F.col("norm")).select("doc_id", "path", F.lit(2).alias("tier"))
    spelled = (
        d.filter(F.col("year").isNotNull())
        .select("doc_id", "year", "ticker", "company", F.explode(aliases).alias("alias"))
        .select("doc_id", F.explode(F.array(*[F.concat(T.doc_key(F.col(n)), "year", "alias") for n in ("ticker", "company")])).alias("norm"))
    )
    three = spelled.join(files, "norm").select("doc_id", "path", F.lit(3).alias("tier"))
    by_year = d.join(files.withColumn("year", F.explode("tokens")), "year")

    def named(name: str):
        words = F.filter(F.transform(F.split(name, "[^A-Za-z0-9]+"), lambda t: T.doc_key(t)), lambda t: F.length(t) > 1)
        whole = (T.doc_key(F.col(name)) != "") & F.array_contains("tokens", T.doc_key(F.col(name)))
        return F.coalesce(whole | ((F.size(words) > 0) & (F.size(F.array_except(words, "tokens")) == 0)), F.lit(False))

    four = by_year.filter(F.arrays_overlap("tokens", aliases) & (named("ticker") | named("company"))).select("doc_id", "path", F.lit(4).alias("tier"))
    best = reduce(DataFrame.unionByName, [one, two, three, four]).groupBy("doc_id").agg(F.min(F.struct("tier", "path")).alias("b"))
    return best.select("doc_id", F.col("b.path").alias("path"), F.col("b.tier").alias("tier"))


def page_headings(pages: DataFrame) -> DataFrame:
    """``(doc_id, page, section, section_heading)``: headings carried forward over a document's pages.

    ``pages`` has ``doc_id, page, text`` and perhaps ``tables``, of which the
    first three lines are read behind the text; the last heading of a page
    wins, and pages before the first heading are 'Unknown'.
    """
    of = lambda t: F.split(F.coalesce(t, F.lit("")), "\r\n|\n|\r")
    every = of(F.col("text"))
    if "tables" in pages.columns:
        tables = F.coalesce("tables", F.expr("CAST(array() AS array<string>)"))
        every = F.concat(every, F.flatten(F.transform(tables, lambda t: F.slice(of(t), 1, 3))))
    lines = pages.select("doc_id", "page", F.posexplode(every).alias("pos", "line"))
    found = lines.withColumn("section", T.heading(F.col("line"), F.col("page"))).filter(F.col("section").isNotNull())
    last = found.groupBy("doc_id", "page").agg(F.max_by(F.struct("section", T.normalize_line(F.col("line")).alias("heading")), "pos").alias("h"))
    w = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    carried = pages.select("doc_id", "page").distinct().join(last, ["doc_id", "page"], "left").withColumn("c", F.last("h", ignorenulls=True).over(w))
    return carried.select(
        "doc_id",
        "page",
        F.coalesce("c.section", F.lit("Unknown")).alias("section"),
        F.coalesce("c.heading", F.lit("")).alias("section_heading"),
    )
