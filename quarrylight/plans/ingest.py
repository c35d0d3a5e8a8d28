"""Registered queries on metadata, ingest state, chunk structure and calculations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import calculations, corrective, filings, lexical
from quarrylight.plans import oracle as O
from quarrylight.session import table
from quarrylight.settings import Settings
from quarrylight.sources import vector_store

PARSER = "p3"
SETTINGS = Settings.from_environment()
BATCH = SETTINGS.batch_size
SETTINGS_KEY = f"{PARSER}|{SETTINGS.chunk_size}|{SETTINGS.chunk_overlap}"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus(table(spark, sf_dir, "chunks"))


def documents_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.first_documents(table(spark, sf_dir, "doc_info"))


def state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = filings.latest_state(table(spark, sf_dir, "ingest_documents"))
    return s.select("doc_id", "status", "chunk_size", "chunk_overlap", "parser_version", "chunk_count", "updated_at")


def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after marking every failed document for another run one day later."""
    state = filings.latest_state(table(spark, sf_dir, "ingest_documents"))
    retry = state.filter(F.col("status") != "complete").withColumn("status", F.lit("pending")).withColumn("updated_at", F.col("updated_at") + 86400)
    return filings.upsert(state, retry).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("updated_at"), 3).alias("last"))


def stale_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run with the present parser and default sizes would have to parse again."""
    state = filings.latest_state(table(spark, sf_dir, "ingest_documents"))
    docs = filings.first_documents(table(spark, sf_dir, "doc_info")).select("doc_id")
    known = state.select("doc_id", "pdf_path", "pdf_mtime_ns")
    wanted = docs.join(known, "doc_id", "left").select(
        "*", F.lit(SETTINGS.chunk_size).alias("chunk_size"), F.lit(SETTINGS.chunk_overlap).alias("chunk_overlap"), F.lit(PARSER).alias("parser_version")
    )
    return filings.stale_documents(state, wanted)


def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = filings.first_documents(table(spark, sf_dir, "doc_info"))
    return filings.resolved_paths(docs, table(spark, sf_dir, "ingest_documents").select(F.col("pdf_path").alias("path")))


def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings processed, chunks created, errors and seconds of all runs in the log."""
    log = table(spark, sf_dir, "ingest_documents").distinct()
    done = F.col("status") == "complete"
    return log.agg(
        F.countDistinct(F.when(done, F.col("doc_id"))).alias("documents"),
        F.coalesce(F.sum(F.when(done, F.col("chunk_count"))), F.lit(0)).alias("chunks"),
        F.count(F.when(F.coalesce(F.col("error"), F.lit("")) != "", 1)).alias("errors"),
        F.round(F.max("updated_at") - F.min("updated_at"), 3).alias("seconds"),
    )


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids delivered more than once, over the whole table."""
    return table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the chunk and vector counts are above zero and equal."""
    c = table(spark, sf_dir, "chunks").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    v = table(spark, sf_dir, "chunk_vectors").agg(F.countDistinct("chunk_id").alias("n_vectors"))
    both = c.join(v)  # one row each
    return both.withColumn("healthy", (F.col("n_chunks") > 0) & (F.col("n_chunks") == F.col("n_vectors")))


def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without a vector."""
    return chunks(spark, sf_dir).join(table(spark, sf_dir, "chunk_vectors").select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")


def batch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each filing's chunk ids in batches, every id followed by a zero character.

    Batches are numbered inside a filing, so the order needs no global sort.
    """
    w = W.partitionBy("doc_id").orderBy("chunk_id")
    each = chunks(spark, sf_dir).select("doc_id", "chunk_id", ((F.row_number().over(w) - 1) / BATCH).cast("int").alias("batch"))
    listed = each.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list("chunk_id")).alias("l"))
    return listed.select("doc_id", "batch", F.sha2(F.array_join(F.transform("l", lambda x: F.concat(x, F.lit("\0"))), ""), 256).alias("batch_key"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fingerprint per company of what the index holds: settings, and the digests of its filings added up."""
    return filings.manifest(chunks(spark, sf_dir), "company", SETTINGS_KEY)


def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies whose index must be rebuilt: their manifest differs from that of the filings with a complete run."""
    c = chunks(spark, sf_dir)
    done = filings.latest_state(table(spark, sf_dir, "ingest_documents")).filter("status = 'complete'").select("doc_id")
    return filings.manifest_changes(filings.manifest(c.join(done, "doc_id", "left_semi"), "company", SETTINGS_KEY), filings.manifest(c, "company", SETTINGS_KEY), "company")


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector store after an upsert by id of re-embedded chunks (every tenth), by model."""
    v = table(spark, sf_dir, "chunk_vectors").filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("v"))
    store = v.select("chunk_id", "v.*", F.lit("first").alias("model"))
    news = store.filter(F.col("vec_id") % 10 == 0).withColumn("model", F.lit("second"))
    return vector_store.upserted(store, news, "chunk_id").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("n_ids"))


def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of fresh filings from the cache before newly parsed ones, each in the order of its filing."""
    c = chunks(spark, sf_dir).select("chunk_id", "doc_id")
    stale = stale_documents(spark, sf_dir).select("doc_id")
    merged = filings.merged_chunks(c.join(stale, "doc_id", "left_anti"), c.join(stale, "doc_id", "left_semi"))
    return merged.groupBy("origin", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("corpus_pos").alias("last_pos"))


def cache_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each filing's cache file."""
    return documents_first(spark, sf_dir).select("doc_id", T.cache_name(F.col("doc_id")).alias("cache_name"))


def state_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older state table, without parser version and count, brought to the present columns."""
    old = filings.latest_state(table(spark, sf_dir, "ingest_documents")).drop("parser_version", "chunk_count")
    return filings.with_columns(old, filings.STATE_DEFAULTS).select("doc_id", "status", "parser_version", "chunk_count")


def file_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata read from file names and the first pages."""
    paths = table(spark, sf_dir, "ingest_documents").select("doc_id", "pdf_path").distinct()
    first = page_texts(spark, sf_dir).filter("page = 1").select("doc_id", "text")
    return filings.file_documents(paths.join(first, "doc_id", "left"), "pdf_path", "text")


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", F.length("indexed").alias("n_chars"), F.md5("indexed").alias("digest"))


def context_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provenance line of each chunk, with the heading its text begins with (its first line if that is a heading)."""
    cols = [F.col(c) for c in ("company", "ticker", "doc_type", "fiscal_year", "page", "section")]
    first = F.try_element_at(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r"), F.lit(1))
    title = F.when(T.heading(first, F.col("page")).isNotNull(), first)
    return chunks(spark, sf_dir).select("chunk_id", T.context_header(*cols, title).alias("header"))


def chunk_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each chunk id begins as its document and page demand."""
    prefix = T.chunk_prefix(F.col("doc_id"), F.col("page"))
    return chunks(spark, sf_dir).filter(F.col("page").isNotNull()).select("chunk_id", prefix.alias("prefix"), F.startswith("chunk_id", prefix).alias("fits"))


def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", T.content_type(F.col("text"), F.col("section")).alias("content_type"))


def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chunks(spark, sf_dir).select("chunk_id", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r")).alias("pos", "line"))
    found = lines.select("chunk_id", "pos", T.normalize_line(F.col("line")).alias("line"), T.heading(F.col("line"), F.col("page")).alias("section"))
    return found.filter(F.col("section").isNotNull())


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the filings, put together from their chunks in order: running text and tables apart."""
    held = chunks(spark, sf_dir).filter(F.col("page").isNotNull()).select(
        "doc_id", "page", "chunk_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("content_type") == "table", F.lit(False)).alias("tab")
    )
    parts = held.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "text", "tab"))).alias("parts"))
    of = lambda tab: F.transform(F.filter("parts", lambda p: p["tab"] == tab), lambda p: p["text"])
    return parts.select("doc_id", "page", F.array_join(of(False), "\n").alias("text"), of(True).alias("tables"))


def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.page_headings(page_texts(spark, sf_dir))


def inferred_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections read from the text where the chunk has none."""
    rows = chunks(spark, sf_dir).filter(F.coalesce(F.trim("section"), F.lit("")).isin("", "Unknown") & F.col("text").isNotNull())
    return rows.select("chunk_id", F.coalesce(T.body_section(F.col("text")), F.lit("Unknown")).alias("section"))


def normalized_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "calc_inputs").filter(F.col("source_text").isNotNull()).select("input_id", F.col("source_text").alias("source")).distinct()
    n = rows.select("input_id", calculations.normalized_number(F.col("source")).alias("n"))
    return n.select("input_id", F.round("n.value", 6).alias("value"), F.col("n.unit").alias("unit"))


def calc_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded operation of each chunk with several figures on its first two, with formula and rounded result."""
    rows = table(spark, sf_dir, "calc_inputs").filter(F.col("input_id").isNotNull() & (F.trim("chunk_id") != "")).dropDuplicates(["input_id"])
    rows = rows.select("chunk_id", "input_id", "operation", "value")
    return calculations.dispatch(calculations.chunk_plans(rows)).withColumn("raw", F.round("raw", 6))


def yearly_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per customer segment and year with its change against the year before."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    per = o.groupBy(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("total"))
    old = F.lag("total").over(W.partitionBy("segment").orderBy("year"))
    change = calculations.raw_result(F.lit("percentage_change"), F.col("total"), F.col("old"))
    step = calculations.raw_result(F.lit("absolute_change"), F.col("total"), F.col("old"))
    return per.withColumn("old", old).select("segment", "year", F.round("total", 2).alias("total"), F.round(change, 4).alias("pct_change"), F.round(step, 2).alias("abs_change"))


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross margin and revenue to cost ratio per return flag, discounts standing for cost."""
    li = table(spark, sf_dir, "lineitem")
    per = li.groupBy("l_returnflag").agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("cost")
    )
    r, c = F.col("revenue"), F.col("cost")
    return per.select(
        "l_returnflag",
        F.round(calculations.raw_result(F.lit("gross_margin"), r, c), 4).alias("gross_margin"),
        F.round(calculations.raw_result(F.lit("margin"), c, r), 4).alias("cost_share"),
        F.round(calculations.raw_result(F.lit("ratio"), r, c), 4).alias("ratio"),
    )


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type (the batch form of the streaming windows)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    per = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return per.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read from the JSON object in a model's reply: fenced, or bare inside other text."""
    e = table(spark, sf_dir, "events")
    fenced = F.concat(F.lit("{no} Here is the result:\n```json\n"), "props", F.lit("\n```\nDone {it}."))
    reply = F.when(F.col("event_id") % 2 == 0, fenced).otherwise(F.concat(F.lit("Result: "), "props", F.lit(" as asked.")))
    found = e.select("event_id", corrective.json_object(reply).alias("found"))
    return found.select("event_id", F.array_join(F.array_sort(F.json_object_keys("found")), ",").alias("keys"), F.length("found").alias("n_chars"))


def balanced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first balanced JSON value in replies with broken brackets before it and after it."""
    e = table(spark, sf_dir, "events")
    reply = F.concat(F.lit("Note {not json, [1, 2 and: "), "props", F.lit(" then } ] {\"late\": 1}"))
    found = calculations.first_json(e.select("event_id", reply.alias("reply")), "reply", "found")
    return found.select("event_id", F.array_join(F.array_sort(F.json_object_keys("found")), ",").alias("keys"))


_LINES = "string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r')"
_STRIP = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"
_STALE = f"""SELECT first.doc_id, CASE WHEN status IS NULL THEN 'new' WHEN status <> 'complete' THEN 'failed'
    WHEN chunk_size IS DISTINCT FROM {SETTINGS.chunk_size} OR chunk_overlap IS DISTINCT FROM {SETTINGS.chunk_overlap} OR parser_version IS DISTINCT FROM '{PARSER}' THEN 'changed' END AS reason
    FROM first LEFT JOIN state USING (doc_id)"""


def _manifest(name: str, source: str) -> str:
    return f"""{name}_ids AS (SELECT DISTINCT company, doc_id FROM {source} WHERE chunk_id IS NOT NULL),
        {name} AS (SELECT company, sha256('{SETTINGS_KEY}|' || count(*) || '|' || CAST(sum(CAST('0x' || substring(md5(doc_id), 1, 8) AS BIGINT)) AS BIGINT)) AS fingerprint FROM {name}_ids GROUP BY company)"""


def _named(x: str, key: str) -> str:
    words = f"list_filter(list_transform(string_split_regex({x}, '[^A-Za-z0-9]+'), lambda t: {O.doc_key('t')}), lambda t: length(t) > 1)"
    return f"({key} <> '' AND list_contains(toks, {key}) OR len({words}) > 0 AND len(list_filter({words}, lambda t: NOT list_contains(toks, t))) = 0)"


_LATEST = "state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC NULLS LAST, pdf_path DESC NULLS LAST, pdf_mtime_ns DESC NULLS LAST, chunk_size DESC NULLS LAST, chunk_overlap DESC NULLS LAST, cache_path DESC NULLS LAST, status DESC NULLS LAST, chunk_count DESC NULLS LAST, error DESC NULLS LAST, parser_version DESC NULLS LAST) AS nth FROM ingest_documents WHERE doc_id IS NOT NULL) WHERE nth = 1)"
_DOCTYPE = "CASE WHEN doc_type IS NULL THEN '10K' WHEN replace(upper(trim(doc_type)), '-', '_') = '10K_ANNUALREPORT' THEN '10K_ANNUAL' ELSE replace(upper(trim(doc_type)), '-', '_') END"
_FIRST = f"""first AS (SELECT doc_id, coalesce(nullif(trim(company), ''), 'Unknown') AS company,
    coalesce(nullif(trim(ticker), ''), upper(coalesce(nullif(trim(company), ''), 'Unknown'))) AS ticker, {_DOCTYPE} AS doc_type, fiscal_year,
    coalesce(source_path, '') AS source_path, coalesce(source_url, '') AS source_url, coalesce(num_pages, 0) AS num_pages
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at NULLS FIRST, source_path NULLS FIRST, source_url NULLS FIRST, company NULLS FIRST, ticker NULLS FIRST, doc_type NULLS FIRST, fiscal_year NULLS FIRST, num_pages NULLS FIRST) AS nth
    FROM doc_info WHERE trim(doc_id) <> '') WHERE nth = 1)"""
_PAGES = """pages AS (SELECT doc_id, page, coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY chunk_id) FILTER (coalesce(content_type, '') <> 'table'), '') AS text,
    coalesce(list(coalesce(text, '') ORDER BY chunk_id) FILTER (content_type = 'table'), []) AS tables FROM corpus WHERE page IS NOT NULL GROUP BY ALL)"""
_RAW = """CASE operation WHEN 'percentage_change' THEN (a - b) / abs(CASE WHEN b <> 0 THEN b END) * 100 WHEN 'absolute_change' THEN a - b
    WHEN 'gross_margin' THEN (a - b) / CASE WHEN a <> 0 THEN a END * 100 WHEN 'ratio' THEN a / CASE WHEN b <> 0 THEN b END
    WHEN 'margin' THEN a / CASE WHEN b <> 0 THEN b END * 100 WHEN 'operating_margin' THEN a / CASE WHEN b <> 0 THEN b END * 100
    WHEN 'net_margin' THEN a / CASE WHEN b <> 0 THEN b END * 100 END"""
_OPS = ", ".join(O.quoted(x) for x in calculations.PLACES)
_MISSING = "a IS NULL OR isnan(a) OR b IS NULL OR isnan(b)"

SQL = {
    "documents_first": f"WITH {_FIRST} SELECT * FROM first",
    "state_latest": f"WITH {_LATEST} SELECT doc_id, status, chunk_size, chunk_overlap, parser_version, chunk_count, updated_at FROM state",
    "state_upsert": f"""WITH {_LATEST}, s AS (SELECT CASE WHEN status <> 'complete' THEN 'pending' ELSE status END AS status,
        CASE WHEN status <> 'complete' THEN updated_at + 86400 ELSE updated_at END AS u FROM state) SELECT status, count(*) AS n, round(max(u), 3) AS last FROM s GROUP BY status""",
    "stale_documents": f"WITH {_LATEST}, {_FIRST} SELECT * FROM ({_STALE}) WHERE reason IS NOT NULL",
    "resolved_paths": f"""WITH {_FIRST}, files AS (SELECT DISTINCT pdf_path AS path, regexp_extract(pdf_path, '([^/]+)\\.pdf$', 1) AS stem FROM ingest_documents),
        f AS (SELECT *, {O.doc_key("stem")} AS norm, list_distinct(list_filter(list_transform(string_split_regex(stem, '[_-]+'), lambda t: {O.doc_key("t")}), lambda t: t <> '')) AS toks FROM files WHERE stem <> ''),
        d AS (SELECT *, {O.doc_key("doc_id")} AS did, {O.doc_key("ticker")} AS tk, {O.doc_key("company")} AS ck, CAST(fiscal_year AS VARCHAR) AS y,
            CASE WHEN {O.doc_key("doc_type")} IN ('10kannual', '10kannualreport') THEN [{O.doc_key("doc_type")}, 'annualreport'] ELSE [{O.doc_key("doc_type")}] END AS al FROM first),
        m AS (SELECT doc_id, path, CASE WHEN stem = doc_id THEN 1 WHEN norm = did THEN 2
            WHEN y IS NOT NULL AND list_contains(list_transform(al, lambda a: tk || y || a) || list_transform(al, lambda a: ck || y || a), norm) THEN 3
            WHEN list_contains(toks, y) AND list_has_any(toks, al) AND ({_named("ticker", "tk")} OR {_named("company", "ck")}) THEN 4 END AS tier FROM d, f)
        SELECT doc_id, arg_min(path, (tier, path)) AS path, CAST(min(tier) AS INTEGER) AS tier FROM m WHERE tier IS NOT NULL GROUP BY doc_id""",
    "normalized_numbers": f"""WITH r AS (SELECT DISTINCT input_id, trim(source_text) AS t FROM calc_inputs WHERE source_text IS NOT NULL),
        n AS (SELECT *, starts_with(t, '(') AND ends_with(t, ')') AS neg FROM r), i AS (SELECT *, CASE WHEN neg THEN substring(t, 2, length(t) - 2) ELSE t END AS x FROM n),
        b AS (SELECT *, regexp_replace(x, '(?i),|\\$|\\bUSD\\b', '', 'g') AS bare FROM i),
        l AS (SELECT *, trim(regexp_replace(bare, '(?i)\\s*\\b(billion|million|thousand)s?\\b|%|\\s*\\bpercent\\b', '', 'g')) AS rest FROM b),
        v AS (SELECT *, CASE WHEN t NOT IN ('—', '-', '–', 'N/A', '') AND regexp_full_match(rest, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(rest AS DOUBLE) * CASE WHEN neg THEN -1 ELSE 1 END END AS value FROM l)
        SELECT input_id, round(value, 6) AS value, CASE WHEN value IS NULL THEN '' ELSE concat_ws(' ', CASE WHEN regexp_matches(x, '(?i)\\$|\\bUSD\\b') THEN 'USD' END,
            CASE WHEN regexp_matches(bare, '(?i)\\bbillions?\\b') THEN 'billions' END, CASE WHEN regexp_matches(bare, '(?i)\\bmillions?\\b') THEN 'millions' END,
            CASE WHEN regexp_matches(bare, '(?i)\\bthousands?\\b') THEN 'thousands' END, CASE WHEN regexp_matches(bare, '(?i)%|\\bpercent\\b') THEN 'percentage' END) END AS unit FROM v""",
    "ingest_totals": """SELECT count(DISTINCT doc_id) FILTER (status = 'complete') AS documents, CAST(coalesce(sum(chunk_count) FILTER (status = 'complete'), 0) AS BIGINT) AS chunks,
        count(*) FILTER (coalesce(error, '') <> '') AS errors, round(max(updated_at) - min(updated_at), 3) AS seconds FROM (SELECT DISTINCT * FROM ingest_documents)""",
    "duplicate_ids": "SELECT chunk_id, count(*) AS n FROM chunks GROUP BY chunk_id HAVING count(*) > 1",
    "index_health": """SELECT n_chunks, n_vectors, n_chunks > 0 AND n_chunks = n_vectors AS healthy FROM
        (SELECT count(DISTINCT chunk_id) AS n_chunks FROM chunks), (SELECT count(DISTINCT chunk_id) AS n_vectors FROM chunk_vectors)""",
    "missing_vectors": "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunk_vectors WHERE chunk_id IS NOT NULL)",
    "batch_keys": f"""WITH {O.CORPUS}, e AS (SELECT doc_id, chunk_id, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1) / {BATCH}) AS INTEGER) AS batch FROM corpus)
        SELECT doc_id, batch, sha256(string_agg(chunk_id || chr(0), '' ORDER BY chunk_id)) AS batch_key FROM e GROUP BY ALL""",
    "manifest": f"WITH {_manifest('m', 'chunks')} SELECT * FROM m",
    "manifest_changes": f"""WITH {_LATEST}, done AS (SELECT * FROM chunks WHERE doc_id IN (SELECT doc_id FROM state WHERE status = 'complete')), {_manifest("old", "done")}, {_manifest("new", "chunks")}
        SELECT new.company, old.fingerprint IS DISTINCT FROM new.fingerprint AS rebuild FROM new LEFT JOIN old ON old.company IS NOT DISTINCT FROM new.company""",
    "vector_upsert": """WITH v AS (SELECT chunk_id, min(vec_id) AS vec_id FROM chunk_vectors WHERE chunk_id IS NOT NULL GROUP BY chunk_id)
        SELECT CASE WHEN vec_id % 10 = 0 THEN 'second' ELSE 'first' END AS model, count(*) AS n, count(DISTINCT chunk_id) AS n_ids FROM v GROUP BY 1""",
    "merged_chunks": f"""WITH {_LATEST}, {_FIRST}, stale AS (SELECT doc_id FROM ({_STALE}) WHERE reason IS NOT NULL),
        c AS (SELECT DISTINCT chunk_id, doc_id FROM chunks WHERE chunk_id IS NOT NULL),
        p AS (SELECT *, CASE WHEN doc_id IN (SELECT doc_id FROM stale) THEN 1 ELSE 0 END AS origin, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS pos FROM c)
        SELECT CAST(origin AS INTEGER) AS origin, doc_id, count(*) AS n, CAST(max(pos) AS INTEGER) AS last_pos FROM p GROUP BY ALL""",
    "cache_names": f"WITH {_FIRST} SELECT doc_id, substring(sha256(doc_id), 1, 24) AS cache_name FROM first",
    "state_defaults": f"WITH {_LATEST} SELECT doc_id, status, '' AS parser_version, CAST(0 AS BIGINT) AS chunk_count FROM state",
    "file_documents": f"""WITH {O.CORPUS}, {_PAGES}, p AS (SELECT DISTINCT doc_id, pdf_path FROM ingest_documents),
        j AS (SELECT regexp_extract(pdf_path, '([^/]+?)(\\.[^./]*)?$', 1) AS stem, pdf_path, substring(text, 1, 2000) AS head FROM p LEFT JOIN (SELECT doc_id, text FROM pages WHERE page = 1) USING (doc_id)),
        t AS (SELECT *, string_split(replace(stem, ' ', '_'), '_') AS parts FROM j),
        u AS (SELECT *, upper(parts[1]) AS ticker, trim(regexp_extract(head, {O.quoted(filings.COMPANY_NAME)}, 1)) AS named FROM t)
        SELECT stem AS doc_id, coalesce(nullif(named, ''), ticker) AS company, ticker, CASE WHEN len(parts) > 2 THEN replace(parts[3], '-', '_') ELSE '10-K' END AS doc_type,
            CAST(coalesce(nullif(regexp_extract(coalesce(parts[2], ''), '[0-9]{{4}}'), ''), '2023') AS INTEGER) AS fiscal_year, pdf_path AS source_path FROM u""",
    "embedding_texts": f"WITH {O.CORPUS} SELECT chunk_id, length(indexed) AS n_chars, md5(indexed) AS digest FROM corpus",
    "context_headers": f"""WITH {O.CORPUS}, h AS (SELECT *, string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r')[1] AS l FROM corpus),
        t AS (SELECT *, {O.line("l")} AS title FROM h)
        SELECT chunk_id, concat_ws(' | ', coalesce(nullif(company, ''), 'Unknown company'), nullif(ticker, ''),
        concat_ws(' ', coalesce(nullif(doc_type, ''), 'filing'), CASE WHEN fiscal_year <> 0 THEN 'FY' || fiscal_year END),
        'page ' || page, CASE WHEN section <> 'Unknown' THEN nullif(section, '') END,
        CASE WHEN {O.heading("l", "page")} IS NOT NULL AND lower(title) <> lower(coalesce(section, '')) THEN title END) AS header FROM t""",
    "chunk_prefixes": f"""WITH {O.CORPUS}, p AS (SELECT chunk_id, substring(sha1(doc_id), 1, 12) || '_p' || lpad(CAST(page AS VARCHAR), CAST(greatest(3, length(CAST(page AS VARCHAR))) AS INTEGER), '0') AS prefix
        FROM corpus WHERE page IS NOT NULL) SELECT chunk_id, prefix, starts_with(chunk_id, prefix) AS fits FROM p""",
    "content_types": f"""WITH {O.CORPUS}, t AS (SELECT chunk_id, section, {_STRIP} AS text FROM corpus)
        SELECT chunk_id, CASE WHEN text = '' THEN 'unknown' WHEN len(list_filter({_LINES}, lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 3 THEN 'table'
        WHEN section = 'Risk Factors' THEN 'risk_factor' WHEN section = 'Footnotes' OR regexp_matches(text, '(?i)\\b(note|footnote)\\s+[0-9]+[A-Za-z]?\\b') THEN 'footnote'
        ELSE 'narrative' END AS content_type FROM t""",
    "heading_lines": f"""WITH {O.CORPUS}, l AS (SELECT chunk_id, page, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) - 1 AS pos FROM corpus)
        SELECT chunk_id, pos, {O.line("line")} AS line, {O.heading("line", "page")} AS section FROM l WHERE {O.heading("line", "page")} IS NOT NULL""",
    "section_carry_forward": f"""WITH {O.CORPUS}, {_PAGES}, w AS (SELECT doc_id, page, {_LINES} || flatten(list_transform(tables, lambda t: string_split_regex(t, '\\r\\n|\\n|\\r')[1:3])) AS lines FROM pages),
        l AS (SELECT doc_id, page, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM w),
        h AS (SELECT doc_id, page, pos, {O.line("line")} AS heading, {O.heading("line", "page")} AS section FROM l),
        last AS (SELECT doc_id, page, arg_max(section, pos) AS section, arg_max(heading, pos) AS heading FROM h WHERE section IS NOT NULL GROUP BY ALL)
        SELECT doc_id, page, coalesce(last_value(section IGNORE NULLS) OVER w, 'Unknown') AS section, coalesce(last_value(heading IGNORE NULLS) OVER w, '') AS section_heading
        FROM (SELECT doc_id, page FROM pages) LEFT JOIN last USING (doc_id, page) WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING)""",
    "inferred_sections": f"""WITH {O.CORPUS} SELECT chunk_id, coalesce({O.body_section("text")}, 'Unknown') AS section FROM corpus
        WHERE coalesce(trim(section), '') IN ('', 'Unknown') AND text IS NOT NULL""",
    "calc_dispatch": f"""WITH r AS (SELECT DISTINCT ON (input_id) input_id, operation, value, chunk_id FROM calc_inputs WHERE input_id IS NOT NULL AND trim(chunk_id) <> '' ORDER BY input_id),
        o AS (SELECT *, row_number() OVER w AS nth, lead(value) OVER w AS b, lead(input_id) OVER w AS next FROM r WINDOW w AS (PARTITION BY chunk_id ORDER BY input_id)),
        p AS (SELECT input_id AS plan_id, operation, value AS a, b FROM o WHERE nth = 1 AND next IS NOT NULL),
        q AS (SELECT *, CASE WHEN operation IS NULL OR operation NOT IN ({_OPS}) THEN 'unknown operation' WHEN {_MISSING} THEN 'missing argument' WHEN {_RAW} IS NULL THEN 'division by zero' ELSE 'ok' END AS status,
            CASE WHEN operation IN ({_OPS}) AND NOT ({_MISSING}) THEN {_RAW} END AS x FROM p)
        SELECT plan_id, operation, status, round(x, 6) AS raw, CASE WHEN operation = 'ratio' THEN round(x, 2) ELSE round(x, 1) END AS result,
            CASE WHEN x IS NOT NULL THEN CASE operation WHEN 'percentage_change' THEN '\\frac{{' || a || ' - ' || b || '}}{{|' || b || '|}} \\times 100' WHEN 'absolute_change' THEN a || ' - ' || b
                WHEN 'gross_margin' THEN '\\frac{{' || a || ' - ' || b || '}}{{' || a || '}} \\times 100' WHEN 'ratio' THEN '\\frac{{' || a || '}}{{' || b || '}}' ELSE '\\frac{{' || a || '}}{{' || b || '}} \\times 100' END END AS formula FROM q""",
    "yearly_change": """WITH p AS (SELECT c_mktsegment AS segment, year(o_orderdate) AS year, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        w AS (SELECT *, lag(total) OVER (PARTITION BY segment ORDER BY year) AS old FROM p)
        SELECT segment, year, round(total, 2) AS total, round((total - old) / abs(old) * 100, 4) AS pct_change, round(total - old, 2) AS abs_change FROM w""",
    "margins": """WITH p AS (SELECT l_returnflag, sum(l_extendedprice) AS r, sum(l_extendedprice * l_discount) AS c FROM lineitem GROUP BY 1)
        SELECT l_returnflag, round((r - c) / r * 100, 4) AS gross_margin, round(c / r * 100, 4) AS cost_share, round(r / c, 4) AS ratio FROM p""",
    "event_windows": """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
    "balanced_json": """SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events""",
    "event_json": """SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys, length(props) AS n_chars FROM events""",
}
QUERIES = {
    f.__name__: f
    for f in (
        documents_first, state_latest, state_upsert, stale_documents, resolved_paths, ingest_totals, duplicate_ids, index_health, missing_vectors,
        batch_keys, manifest, manifest_changes, vector_upsert, merged_chunks, cache_names, state_defaults, file_documents, embedding_texts, context_headers, chunk_prefixes, content_types, heading_lines, section_carry_forward,
        inferred_sections, normalized_numbers, calc_dispatch, yearly_change, margins, event_windows, event_json, balanced_json,
    )
}


def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings' pages chunked again, with carried sections and ids."""
    from quarrylight.operators import chunking

    pages = page_texts(spark, sf_dir)
    placed = pages.join(filings.page_headings(pages).select("doc_id", "page", "section"), ["doc_id", "page"])
    return chunking.chunk_pages(placed.withColumn("tables", F.lit(None).cast("array<string>")))


QUERIES["recursive_chunks"] = recursive_chunks
