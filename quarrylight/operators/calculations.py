"""Deterministic financial calculations and number normalisation."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Decimal places of each operation's result.
PLACES = {
    "percentage_change": 1, "absolute_change": 1, "margin": 1, "gross_margin": 1, "operating_margin": 1, "net_margin": 1, "ratio": 2,
}


def raw_result(operation: Column, a: Column, b: Column) -> Column:
    """The operation on its two arguments in order, unrounded; null where it has no result.

    Arguments: new and old, numerator and denominator, or revenue and cost.  A
    zero divisor, a missing argument and an unknown operation give null.
    """
    safe = F.when(b != 0, b)
    first = F.when(a != 0, a)
    return (
        F.when(operation == "percentage_change", (a - b) / F.abs(safe) * 100)
        .when(operation == "absolute_change", a - b)
        .when(operation == "gross_margin", (a - b) / first * 100)
        .when(operation.isin("margin", "operating_margin", "net_margin"), a / safe * 100)
        .when(operation == "ratio", a / safe)
    )


def written(x: Column) -> Column:
    """A number in full digits, as Python writes it up to 1e16: 12345678.0, not 1.2345678E7."""
    t = x.cast("string")
    sign, head, tail = (F.regexp_extract(t, r"^(-?)(\d)\.(\d+)E(\d+)$", i) for i in (1, 2, 3))
    power = F.regexp_extract(t, r"E(\d+)$", 1).cast("int")
    digits = F.rpad(F.concat(head, tail), F.greatest(power + 2, F.length(tail) + 1), F.lit("0"))
    plain = F.concat(sign, F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits)))
    return F.when(t.rlike(r"E\d+$") & (F.abs(x) < 1e16), plain).otherwise(t)


def formula(operation: Column, a: Column, b: Column) -> Column:
    """The calculation written out in LaTeX; null where ``raw_result`` has none."""
    x, y = written(a), written(b)
    part = lambda *p: F.concat(*[F.lit(q) if isinstance(q, str) else q for q in p])
    quotient = part("\\frac{", x, "}{", y, "}")
    shown = (
        F.when(operation == "percentage_change", part("\\frac{", x, " - ", y, "}{|", y, "|} \\times 100"))
        .when(operation == "absolute_change", part(x, " - ", y))
        .when(operation == "gross_margin", part("\\frac{", x, " - ", y, "}{", x, "} \\times 100"))
        .when(operation == "ratio", quotient)
        .otherwise(part(quotient, " \\times 100"))
    )
    return F.when(raw_result(operation, a, b).isNotNull(), shown)


def even_rounded(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Values rounded as binary numbers, halves to even; only what lies next to a half is looked at one by one."""
    power = 10.0**places
    scaled = values * power
    with np.errstate(invalid="ignore"):
        out = np.rint(scaled) / power
        near = np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-6
        unsure = np.flatnonzero(near | (np.abs(scaled) > 1e9))
    for i in unsure:
        if np.isfinite(values[i]):
            out[i] = round(float(values[i]), int(places[i]))
    return out


def python_round(rows: DataFrame, value: str, places: str, out: str) -> DataFrame:
    """Adds ``out``: the value rounded as a binary number, halves to even, a batch at a time.

    No built-in rounds the binary value itself: 2.675 to two places is 2.67.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` double"

    def batch_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pc.and_(batch.column(value).is_valid(), batch.column(places).is_valid())
            v = batch.column(value).fill_null(0.0).to_numpy(zero_copy_only=False)
            p = batch.column(places).fill_null(0).to_numpy(zero_copy_only=False)
            rounded = pc.if_else(known, pa.array(even_rounded(v, p)), pa.scalar(None, pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, rounded], [*batch.schema.names, out])

    return rows.mapInArrow(batch_round, schema)


def chunk_plans(inputs: DataFrame) -> DataFrame:
    """``(plan_id, operation, a, b)``: for each chunk with several inputs the operation of its first on its first two values."""
    w = W.partitionBy("chunk_id").orderBy("input_id")
    placed = inputs.withColumns({"nth": F.row_number().over(w), "b": F.lead("value").over(w), "next": F.lead("input_id").over(w)})
    return placed.filter("nth = 1 AND next IS NOT NULL").select(F.col("input_id").alias("plan_id"), "operation", F.col("value").alias("a"), "b")


def first_json(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the first balanced object or array in a text that reads as JSON, or null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` string"

    def first(t: str | None) -> str | None:
        for m in re.finditer(r"[{\[]", t or ""):
            try:
                return t[m.start() : json.JSONDecoder().raw_decode(t, m.start())[1]]
            except ValueError:
                continue
        return None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([first(t) for t in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])

    return rows.mapInArrow(search, schema)


def dispatch(plans: DataFrame) -> DataFrame:
    """``(plan_id, operation, formula, raw, result, status)`` of plan rows ``(plan_id, operation, a, b)``.

    ``status`` keeps why a row has no result: unknown operation, missing
    argument or division by zero.
    """
    known = F.col("operation").isin(*PLACES)
    status = (
        F.when(~known | F.col("operation").isNull(), "unknown operation")
        .when(F.col("a").isNull() | F.isnan("a") | F.col("b").isNull() | F.isnan("b"), "missing argument")
        .when(raw_result(F.col("operation"), F.col("a"), F.col("b")).isNull(), "division by zero")
        .otherwise("ok")
    )
    places = F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv])
    judged = plans.select("plan_id", "operation", "a", "b").withColumn("status", status)
    judged = judged.withColumn("raw", F.when(F.col("status") == "ok", raw_result(F.col("operation"), F.col("a"), F.col("b"))))
    judged = judged.withColumn("formula", F.when(F.col("status") == "ok", formula(F.col("operation"), F.col("a"), F.col("b"))))
    rounded = python_round(judged.withColumn("places", F.try_element_at(places, F.col("operation"))), "raw", "places", "result")
    return rounded.select("plan_id", "operation", "formula", "raw", "result", "status")


def normalized_number(text: Column) -> Column:
    """``(value, unit)`` of a disclosed number; scale words name the unit and do not scale.

    Dashes, N/A and blanks have no value; brackets are negative; $, USD and
    commas go; anything that is then no number has neither value nor unit.
    """
    t = F.trim(text)
    negative = F.startswith(t, F.lit("(")) & F.endswith(t, F.lit(")"))
    inner = F.when(negative, F.expr("substring(trim(source), 2, length(trim(source)) - 2)")).otherwise(t)
    bare = F.regexp_replace(inner, r"(?i),|\$|\bUSD\b", "")
    names = []
    for word in ("billion", "million", "thousand"):
        names.append(F.when(bare.rlike(rf"(?i)\b{word}s?\b"), F.lit(f"{word}s")))
    dollars = F.when(inner.rlike(r"(?i)\$|\bUSD\b"), F.lit("USD"))
    share = F.when(bare.rlike(r"(?i)%|\bpercent\b"), F.lit("percentage"))
    left = F.trim(F.regexp_replace(bare, r"(?i)\s*\b(billion|million|thousand)s?\b|%|\s*\bpercent\b", ""))
    number = F.when(left.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), left.cast("double"))
    value = F.when(~t.isin("—", "-", "–", "N/A", ""), F.when(negative, -number).otherwise(number))
    unit = F.when(value.isNotNull(), F.concat_ws(" ", dollars, *names, share)).otherwise("")
    return F.struct(value.alias("value"), unit.alias("unit"))
