"""BM25 over chunks: an index with corpus statistics, best matches, filters and relaxation.

The index is a written table: each chunk once, with its terms, company and
year, and the weight of every term of the corpus.  A stated set of queries is
searched in blocks: a block's term weights, a matrix of bounded size, go to the
tasks, every task scores its chunks against all queries of the block and keeps
its own k best of each, so only those are shuffled.  Filters travel with the
queries and are applied where the chunks are scored; no chunk is ever joined
with the queries that may see it, so a company with a third of all chunks is
no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.best import Best, eligible, query_blocks, top_k
from quarrylight.session import materialise, together

K1, B, EPSILON = 1.5, 0.75, 0.25  # Okapi parameters
BLOCK = 1024  # queries searched at once: some 1000 x 10,000 weights, 80 MB


def corpus(chunks: DataFrame) -> DataFrame:
    """The chunks, each id once, with the text that is indexed.

    Repeated rows count once; null ids are left out; null texts count as empty.
    """
    return chunks.filter(F.col("chunk_id").isNotNull()).dropDuplicates(["chunk_id"]).withColumn(
        "indexed", T.embedding_text(F.col("context_header"), F.col("text"))
    )


def indexed_rows(docs: DataFrame) -> DataFrame:
    """``(chunk_id, company, fiscal_year, terms)`` of a corpus."""
    return docs.select("chunk_id", "company", F.col("fiscal_year").cast("int").alias("fiscal_year"), T.terms(F.col("indexed")).alias("terms"))


def postings(rows: DataFrame) -> DataFrame:
    """``(chunk_id, term, tf, dl)``."""
    each = rows.select("chunk_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return each.groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(rows: DataFrame) -> DataFrame:
    """One row: number of chunks ``n`` and mean length ``avgdl``, over all chunks."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("avgdl"))


def term_stats(rows: DataFrame) -> DataFrame:
    """``(term, df, idf)``; a negative idf becomes a share of the vocabulary's mean."""
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))  # one row
    held = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = held.join(n).withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))  # one row
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(mean).select("term", "df", idf.alias("idf"))


@dataclass(frozen=True)
class Index:
    """Chunks with their terms, term weights and the mean length of a chunk."""

    rows: DataFrame
    idf: DataFrame
    avgdl: float

    @classmethod
    def build(cls, docs: DataFrame) -> Index:
        """The index of a corpus, written to the shared folder so that every search reads it."""
        rows = materialise(indexed_rows(docs), "index")
        idf, mean = together(lambda: materialise(term_stats(rows), "terms"), lambda: corpus_stats(rows).first()["avgdl"])
        return cls(rows, idf, mean or 1.0)

    def write(self, folder: str) -> None:
        """Keeps the index in a folder, in place of what is there."""
        self.rows.write.mode("overwrite").parquet(f"{folder}/rows")
        self.idf.write.mode("overwrite").parquet(f"{folder}/terms")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Index:
        """An index written before."""
        rows = spark.read.parquet(f"{folder}/rows")
        return cls(rows, spark.read.parquet(f"{folder}/terms"), corpus_stats(rows).first()["avgdl"] or 1.0)


def query_weights(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """``(query_id, term, weight)``: a term repeated in the query counts each time."""
    asked = queries.select("query_id", F.explode(T.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(
        F.count(F.lit(1)).alias("qtf")
    )
    return asked.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))


def best_matches(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the k best chunks of each query.

    ``queries`` has ``query_id`` and ``query`` and may have ``company`` (met
    without regard to case) and ``fiscal_year``, which every hit must then
    have; null demands nothing.  Chunks without a matching term follow with
    score 0; ties go to the smaller chunk id.
    """
    for name, kind_ in (("company", "string"), ("fiscal_year", "int")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind_))
    kind = queries.schema["query_id"].dataType.simpleString()
    weights = query_weights(queries, index.idf)
    listed = weights.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    asked = queries.select("query_id", T.fold(F.col("company")).alias("company"), F.col("fiscal_year").cast("int").alias("fiscal_year"))
    asked = asked.join(listed, "query_id", "left")
    rows = index.rows.select("chunk_id", T.fold(F.col("company")).alias("company"), "fiscal_year", "terms")
    parts = []
    for held in query_blocks(asked, BLOCK):
        shared = queries.sparkSession.sparkContext.broadcast(block_weights(held))
        parts.append(rows.mapInArrow(block_search(shared, k, index.avgdl), f"query_id {kind}, chunk_id string, score double"))
    return top_k(reduce(DataFrame.unionByName, parts), k, ["query_id"])


def block_weights(held: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Vocabulary, weights (term x query), query ids and demands of a block of queries."""
    flat = lambda name: pa.concat_arrays([c.flatten() for c in held.column(name).chunks]) if held.num_rows else pa.array([])
    terms, weights = flat("terms"), flat("weights")
    sizes = pc.fill_null(pc.list_value_length(held.column("terms")), 0).to_numpy() if held.num_rows else np.zeros(0, np.int64)
    vocabulary = pc.unique(terms) if len(terms) else pa.array([], pa.string())
    matrix = np.zeros((len(vocabulary), held.num_rows))
    if len(terms):
        matrix[pc.index_in(terms, vocabulary).to_numpy(), np.repeat(np.arange(held.num_rows), sizes)] = weights.to_numpy()
    one = lambda name: pa.concat_arrays(held.column(name).chunks) if held.num_rows else pa.array([], held.schema.field(name).type)
    return vocabulary, matrix, one("query_id"), one("company"), one("fiscal_year")


def block_search(shared, k: int, avgdl: float, slice_: int = 1024):
    """The task that scores its chunks against a block of queries and keeps the best of each."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, matrix, ids, companies, years = shared.value
        if not len(ids):
            return
        best = Best(k, len(ids))
        for whole in batches:
            for start in range(0, whole.num_rows, slice_):
                batch = whole.slice(start, slice_)
                terms = batch.column("terms")
                lengths = terms.value_lengths().to_numpy(zero_copy_only=False)
                known = pc.index_in(terms.flatten(), vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.repeat(np.arange(batch.num_rows), lengths)[known >= 0]
                pair, tf = np.unique(at * max(1, len(vocabulary)) + known[known >= 0], return_counts=True)
                row, term = np.divmod(pair, max(1, len(vocabulary)))
                impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / avgdl))
                score = np.zeros((batch.num_rows, len(ids)))
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
                for r in range(batch.num_rows):
                    s, e = bounds[r], bounds[r + 1]
                    if e > s:
                        score[r] = impact[s:e] @ matrix[term[s:e]]
                score[~eligible(batch.column("company"), batch.column("fiscal_year"), companies, years)] = -np.inf
                best.add(score, batch.column("chunk_id"))
        yield from best.rows_of(ids)

    return search


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 of a folded text."""
    return F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), F.lit(1))


def infer_filters(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, company, fiscal_year)`` that a query names; null where it names none.

    The longest company name contained in the query wins; without one, the
    company with most tokens in common (legal forms aside), then with more
    tokens, then the greater name.  A year counts if it is the only one.
    Companies meet queries over shared tokens other than legal forms (all
    tokens for a name of legal forms alone, the first character for a name
    without tokens), not all with all.
    """
    q = queries.select("query_id", T.fold(F.col("query")).alias("folded"), T.years(F.col("query")).alias("years"))
    named = chunks.filter(F.trim("company") != "").select("company").distinct().withColumn("name", T.fold(F.col("company")))
    legal = F.array(*[F.lit(w) for w in T.COMPANY_WORDS])
    tokens = F.array_distinct(words(F.col("name")))
    named = named.withColumn("own", F.array_except(tokens, legal)).withColumn(
        "keys", F.when(F.size("own") > 0, F.col("own")).when(F.size(tokens) > 0, tokens).otherwise(F.array(F.substring(F.trim("name"), 1, 1)))
    )
    letters = F.split(F.regexp_replace("folded", r"[a-z0-9\s]", ""), "")
    q_keys = q.select("query_id", "folded", F.explode(F.array_distinct(F.concat(words(F.col("folded")), letters))).alias("key"))
    met = q_keys.join(named.select("company", "name", "own", F.explode("keys").alias("key")), "key")
    shared = met.groupBy("query_id", "company").agg(
        F.first("folded").alias("folded"),
        F.first("name").alias("name"),
        F.first("own").alias("own"),
        F.count(F.when(F.array_contains("own", F.col("key")), 1)).alias("overlap"),
    )
    scored = shared.select(
        "query_id", "company", F.contains("folded", "name").alias("whole"), "overlap", F.size("own").alias("own")
    ).filter(F.col("whole") | (F.col("overlap") > 0))
    order = W.partitionBy("query_id").orderBy(
        F.desc("whole"),
        F.desc(F.when(F.col("whole"), F.length("company")).otherwise(F.col("overlap"))),
        F.desc(F.when(F.col("whole"), F.lit(0)).otherwise(F.col("own"))),
        F.when(F.col("whole"), F.col("company")),
        F.desc("company"),
    )
    best = scored.withColumn("at", F.row_number().over(order)).filter(F.col("at") == 1).select("query_id", "company")
    year = F.when(F.size("years") == 1, F.element_at("years", 1))
    return q.join(best, "query_id", "left").select("query_id", "company", year.alias("fiscal_year"))


def merged_filters(explicit: DataFrame, inferred: DataFrame) -> DataFrame:
    """``(query_id, company, fiscal_year, explicit)``: a stated filter wins over the inferred one, field by field.

    A blank company counts as not stated, but ``explicit`` says whether either field was stated at all.
    """
    own = explicit.select("query_id", F.col("company").alias("c"), F.col("fiscal_year").cast("int").alias("y"))
    both = own.join(inferred, "query_id", "left")
    return both.select(
        "query_id",
        F.coalesce(F.nullif("c", F.lit("")), F.nullif("company", F.lit(""))).alias("company"),
        F.coalesce("y", "fiscal_year").alias("fiscal_year"),
        (F.col("c").isNotNull() | F.col("y").isNotNull()).alias("explicit"),
    )


def relaxed_filters(filters: DataFrame, rows: DataFrame, same: Column | None = None) -> DataFrame:
    """The filters with the year dropped where nothing has it, and their ``tier``.

    Tier 0 keeps what was asked, 1 has dropped the year beside a company, 2
    demands nothing.  The company stays in any case.  What the corpus has is
    known from one partial aggregate of companies and years; ``same`` maps a
    company to the form in which names are compared (lower case by default).
    """
    key = (lambda c: T.fold(F.col(c))) if same is None else F.col
    have = rows.groupBy(key("company").alias("c"), F.col("fiscal_year").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    f = filters.withColumn("c", key("company"))
    pair = have.filter(F.col("c").isNotNull() & F.col("y").isNotNull()).select("c", F.col("y").alias("fiscal_year"), F.lit(True).alias("pair"))
    only = have.filter(F.col("y").isNotNull()).select(F.col("y").alias("fiscal_year")).distinct().withColumn("year", F.lit(True))
    met = f.join(pair, ["c", "fiscal_year"], "left").join(only, "fiscal_year", "left")
    kept = F.when(F.col("c").isNotNull(), F.col("pair")).otherwise(F.col("year"))
    year = F.when(kept, F.col("fiscal_year"))
    tier = F.when(F.col("c").isNull() & year.isNull(), 2).when(F.col("fiscal_year").isNull() | kept, 0).otherwise(1)
    return met.select("query_id", "company", year.alias("fiscal_year"), tier.alias("tier"))


def relaxed_top_k(queries: DataFrame, index: Index, filters: DataFrame, k: int) -> DataFrame:
    """Filtered BM25 with relaxation: ``(query_id, tier, chunk_id, score, rank)``."""
    f = relaxed_filters(filters, index.rows)
    hits = best_matches(queries.select("query_id", "query").join(f, "query_id", "left"), index, k)
    return hits.join(f.select("query_id", "tier"), "query_id")
