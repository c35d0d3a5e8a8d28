"""Registered queries on the quality of recorded quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import units
from quarrylight.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every amount that can be told, in the common unit of its kind."""
    amounts = units.common_amounts(table(spark, sf_dir, "calc_inputs"), table(spark, sf_dir, "calc_measures"))
    return amounts.select(F.col("id").alias("input_id"), "common_unit", F.round("amount").cast("bigint").alias("common_value"))


def p3_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of the amounts: residual of the identity, and whether the solution is the only one."""
    amounts = units.common_amounts(table(spark, sf_dir, "calc_inputs"), table(spark, sf_dir, "calc_measures"))
    return amounts.select(F.col("id").alias("input_id"), "residual", "solutions", (F.col("solutions") > 1).alias("not_unique"))


def p3_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of one filing and year tied by an identity: the units that fit it best, and whether they are the only ones."""
    inputs = table(spark, sf_dir, "calc_inputs").filter(F.trim("chunk_id") != "")
    placed = inputs.withColumn("filing", F.split_part("chunk_id", F.lit("_"), F.lit(1))).withColumn("year", F.nullif(F.regexp_extract("label", "(FY[0-9]{4})", 1), F.lit("")))
    return units.joint_amounts(placed, table(spark, sf_dir, "calc_measures"), ["filing", "year"])


QUERIES = {f.__name__: f for f in (p3_found, p3_solutions, p3_identities)}
SQL: dict[str, str] = {}
