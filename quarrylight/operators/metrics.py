"""Retrieval metrics over ranked keys and gold keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K_VALUES = (1, 3, 5, 10)


def run_ranks(samples: DataFrame, retrieved: str) -> DataFrame:
    """``(sample_id, key, rank)``: distinct keys by their best place, ranks closed up."""
    each = samples.select("sample_id", F.posexplode(retrieved).alias("pos", "key")).filter(F.col("key").isNotNull())
    best = each.groupBy("sample_id", "key").agg(F.min("pos").alias("pos"))
    return best.select("sample_id", "key", F.row_number().over(W.partitionBy("sample_id").orderBy("pos")).alias("rank"))


def sample_metrics(samples: DataFrame, gold: str, retrieved: str) -> DataFrame:
    """Per sample with gold keys: mrr, and precision, recall, ndcg and hit rate at each k."""
    relevant = samples.select("sample_id", F.explode(F.array_distinct(gold)).alias("key")).filter(F.col("key").isNotNull())
    sizes = relevant.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = relevant.join(run_ranks(samples, retrieved), ["sample_id", "key"])
    aggs = [F.max(1.0 / F.col("rank")).alias("mrr")]
    for k in K_VALUES:
        aggs.append(F.sum((F.col("rank") <= k).cast("int")).alias(f"hits_{k}"))
        aggs.append(F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0))).alias(f"dcg_{k}"))
    found = sizes.join(hits.groupBy("sample_id").agg(*aggs), "sample_id", "left")
    out = [F.col("sample_id"), F.round(F.coalesce("mrr", F.lit(0.0)), 6).alias("mrr")]
    for k in K_VALUES:
        n, dcg = F.coalesce(f"hits_{k}", F.lit(0)), F.coalesce(f"dcg_{k}", F.lit(0.0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold").cast("int"))), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
        out += [
            F.round(n / F.lit(k), 6).alias(f"precision_{k}"),
            F.round(n / F.col("n_gold"), 6).alias(f"recall_{k}"),
            F.round(dcg / ideal, 6).alias(f"ndcg_{k}"),
            (n > 0).cast("int").cast("double").alias(f"hit_rate_{k}"),
        ]
    return found.select(*out)


def mean_metrics(per_sample: DataFrame) -> DataFrame:
    """One row: number of scored samples and the mean of every metric."""
    names = [c for c in per_sample.columns if c != "sample_id"]
    return per_sample.agg(F.count(F.lit(1)).alias("n_scored"), *[F.round(F.avg(c), 6).alias(c) for c in names])
