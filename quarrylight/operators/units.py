"""Quantities in different units: one amount per record in the common unit of its kind.

A record states an amount up to twice: as ``value`` with ``unit`` and inside
``source_text``.  Both statements are of one quantity, so in logarithms

    ln |value| + ln (its unit) = ln |figure in the text| + ln (the text's unit)

Unit columns are often partial (a currency without its scale) or wrong, so each
record has several candidate units for its value; the one with the least
residual of this identity is taken, and a record whose best candidates give
different amounts is flagged as not unique.

Quantities of one place and year are also tied to each other (``IDENTITIES``:
earnings per share times shares are the net income; a margin of the revenue is
what the costs leave).  ``joint_amounts`` tries every combination of their
candidate units and takes the one with the least residual of the identity in
logarithms; combinations that fit equally well are flagged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import materialise

# Scale words, currencies and units with their factor to the common unit.
SCALES = {
    "thousand": 1e3, "thousands": 1e3, "k": 1e3, "'000": 1e3, "000": 1e3, "000s": 1e3, "tsd": 1e3, "t": 1e3,
    "million": 1e6, "millions": 1e6, "m": 1e6, "mm": 1e6, "mn": 1e6, "mio": 1e6, "mln": 1e6,
    "billion": 1e9, "billions": 1e9, "b": 1e9, "bn": 1e9, "mrd": 1e9,
    "lakh": 1e5, "lakhs": 1e5, "crore": 1e7, "crores": 1e7,
}
CURRENCIES = {
    "us$": "USD", "usd": "USD", "$": "USD", "us dollars": "USD", "us dollar": "USD", "dollars": "USD", "dollar": "USD",
    "eur": "EUR", "€": "EUR", "euro": "EUR", "euros": "EUR", "gbp": "GBP", "£": "GBP", "pounds sterling": "GBP",
    "inr": "INR", "rs.": "INR", "rs": "INR", "rupees": "INR", "₹": "INR",
}
LB, SHORT_TON, ACRE, SQ_FT, GALLON = 0.45359237, 907.18474, 4046.8564224, 0.09290304, 1 / 42
UNITS = {
    "%": ("share", 100), "pct": ("share", 100), "percent": ("share", 100), "per cent": ("share", 100), "% of total": ("share", 100),
    "percentage points": ("share", 100), "percentage point": ("share", 100), "pp": ("share", 100),
    "‰": ("share", 10), "per mille": ("share", 10), "bp": ("share", 1), "bps": ("share", 1), "basis points": ("share", 1),
    "basis point": ("share", 1), "ratio": ("share", 1e4), "decimal": ("share", 1e4), "fraction": ("share", 1e4), "x of 1": ("share", 1e4),
    "shares": ("shares", 1), "share": ("shares", 1), "shs": ("shares", 1), "number of shares": ("shares", 1),
    "usd/share": ("per_share", 100), "$/share": ("per_share", 100), "us$/share": ("per_share", 100), "$ per share": ("per_share", 100),
    "us$ per share": ("per_share", 100), "usd per share": ("per_share", 100), "dollars per share": ("per_share", 100),
    "cents per share": ("per_share", 1), "us cents/share": ("per_share", 1), "us cents per share": ("per_share", 1),
    "c/share": ("per_share", 1), "¢ per share": ("per_share", 1), "¢/share": ("per_share", 1),
    "kwh": ("energy", 1), "kilowatt hours": ("energy", 1), "kilowatt-hours": ("energy", 1), "mwh": ("energy", 1e3),
    "megawatt hours": ("energy", 1e3), "megawatt-hours": ("energy", 1e3), "gwh": ("energy", 1e6), "gigawatt-hours": ("energy", 1e6),
    "twh": ("energy", 1e9), "terawatt-hours": ("energy", 1e9), "gj": ("energy", 1e3 / 3.6), "gigajoules": ("energy", 1e3 / 3.6),
    "mj": ("energy", 1 / 3.6), "tj": ("energy", 1e6 / 3.6),
    "kg": ("mass", 1), "kilograms": ("mass", 1), "kilogram": ("mass", 1), "tonnes": ("mass", 1e3), "tonne": ("mass", 1e3),
    "metric tons": ("mass", 1e3), "metric tonnes": ("mass", 1e3), "kt": ("mass", 1e6), "lb": ("mass", LB), "lbs": ("mass", LB),
    "pounds": ("mass", LB), "short tons": ("mass", SHORT_TON), "us tons": ("mass", SHORT_TON), "g": ("mass", 1e-3),
    "sqm": ("area", 1), "m2": ("area", 1), "m²": ("area", 1), "square metres": ("area", 1), "square meters": ("area", 1), "ha": ("area", 1e4),
    "hectares": ("area", 1e4), "acres": ("area", ACRE), "acre": ("area", ACRE), "sq ft": ("area", SQ_FT), "sq. ft.": ("area", SQ_FT),
    "square feet": ("area", SQ_FT), "ft²": ("area", SQ_FT), "ft2": ("area", SQ_FT), "km2": ("area", 1e6), "km²": ("area", 1e6),
    "bbl": ("volume", 1), "barrels": ("volume", 1), "barrel": ("volume", 1), "kbbl": ("volume", 1e3), "mbbl": ("volume", 1e3),
    "mmbbl": ("volume", 1e6), "gal": ("volume", GALLON), "gallons": ("volume", GALLON), "us gallons": ("volume", GALLON), "us gal": ("volume", GALLON),
}

BLANKS = "\\u00a0\\u2007\\u2009\\u202f "  # between groups of digits
SIGN = r"[-−–+]?\s*"
SYMBOL = r"us\$|\$|€|£|₹|usd|eur|gbp|inr|rs\.?"
GLUED = re.compile(rf"^(?P<t>t|k)(?P<a>€|eur|£|\$)$|^(?P<b>{SYMBOL})(?P<c>k|mm|mn|m|bn|b|000)$")
GERMAN = re.compile(r"\b(?:teur|mio\.?|mrd\.?|tsd\.?)|\bt€", re.I)
NUMBER = re.compile(rf"\d{{1,3}}(?:[.,'’{BLANKS}]\d{{3}})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,]\d+)?")
NOT_FIGURES = re.compile(r"\(000s\)|'000|\bx of 1\b|\b(?:k?m|ft)2\b|\b(?:see )?note \d+|\bFY\d{2,4}\b|(?<![\d.,])10-?[KQ]\b", re.I)
PREFIX = re.compile(rf"(?:\b(?:teur|t€|mio\. ?(?:eur|€)|mrd\. ?(?:eur|€))|(?:us\$|\$|€|£|₹|\busd|\beur|\bgbp|\binr|\brs\.?))\s*\(?\s*{SIGN}$", re.I)
HEADER = re.compile(r"\(([^()|]*?)(?:, except[^()]*)?\)\s*\||\bamounts in ([^–:|]+?)\s*[–:|-]", re.I)


@lru_cache(maxsize=65536)
def parse_unit(text: str | None) -> tuple[str, str | None, float, bool] | None:
    """``(kind, currency, factor, names a scale)`` of a unit's spelling, or None.

    A scale alone is of the kind money, without a currency.
    """
    if text is None:
        return None
    t = re.sub(r"\s+", " ", text.strip().lower())  # \s holds the no-break spaces
    if t in UNITS:
        kind, factor = UNITS[t]
        return kind, None, factor, False
    if t == "t":
        return "mass", None, 1e3, False
    t = re.sub(r"\s+", " ", re.sub(r"[()]", " ", t)).strip()
    t = re.sub(r"\bin (?=\w)", "", t)
    words, scale, scaled, rest = t.split(" "), 1.0, False, []
    for w in words:
        glued = GLUED.match(w)
        if glued:
            scale *= SCALES[glued["t"] or glued["c"]]
            scaled = True
            rest.append(glued["a"] or glued["b"])
        elif w.rstrip(".") in SCALES and w not in ("t",):
            scale *= SCALES[w.rstrip(".")]
            scaled = True
        elif w not in ("of", ""):
            rest.append(w)
    base = " ".join(rest)
    if base in CURRENCIES:
        return "money", CURRENCIES[base], scale, scaled
    if base in ("tonnes", "t") or base in UNITS:
        kind, factor = UNITS.get(base, ("mass", 1e3))
        return kind, None, factor * scale, scaled
    if base == "" and scaled:
        return "money", None, scale, True
    return None


def parse_number(figure: str, german: bool) -> float:
    """A figure's amount, by the notation of its separators."""
    f = re.sub(rf"['’{BLANKS}]", "", figure)
    if german:
        f = f.replace(".", "").replace(",", ".")
    elif "," in f and "." in f:
        decimal = max(f.rfind(","), f.rfind("."))
        f = re.sub(r"[.,]", "", f[:decimal]) + "." + f[decimal + 1 :]
    elif re.fullmatch(r"\d{1,3}(?:,\d{3})+", f):
        f = f.replace(",", "")
    elif f.count(".") > 1:
        f = f.replace(".", "")
    else:
        f = f.replace(",", ".")
    return float(f)


def parse_text(text: str | None) -> tuple[float | None, tuple[str, str | None, float, bool] | None]:
    """``(figure, unit)`` that a source text states; unit as in ``parse_unit``."""
    if not text:
        return None, None
    masked = NOT_FIGURES.sub(lambda m: " " * len(m.group()), text)
    figures = list(NUMBER.finditer(masked))
    if not figures:
        return None, None
    m = figures[-1]
    before, after = text[: m.start()], text[m.end() :]
    negative = bool(re.search(r"[-−]\s*(?:us\$|usd|[$€£₹])?\s*$", before, re.I)) or bool(re.match(r"[-−](?!\s?\w)", after))
    if re.search(r"\(\s*(?:us\$|usd|eur|gbp|inr|rs\.?|[$€£₹])?\s*$", before, re.I) and after.startswith(")"):
        negative = True
    prefix = PREFIX.search(before)
    lead = re.sub(r"[-−–+(\s]+$", "", prefix.group()) if prefix else ""
    trail = re.sub(r"^[)\-−]+", "", after).strip(" |.;")
    unit = parse_unit(f"{lead} {trail}".strip()) or parse_unit(f"{lead} {trail}.".strip())
    header = HEADER.search(before)
    if header and (unit is None or not unit[3]):
        stated = parse_unit((header[1] or header[2]).strip())
        if stated and unit and unit[0] == stated[0]:
            unit = (unit[0], unit[1] or stated[1], unit[2] * stated[2], True)
        else:
            unit = unit or stated
    amount = parse_number(m.group(), bool(GERMAN.search(lead) or GERMAN.search(trail)))
    return (-amount if negative else amount), unit


def statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parsed unit and text of each record."""
    kinds = pa.struct([("kind", pa.string()), ("currency", pa.string()), ("factor", pa.float64()), ("scaled", pa.bool_())])

    def as_struct(u):
        return None if u is None else dict(zip(("kind", "currency", "factor", "scaled"), u))

    for batch in batches:
        units = [as_struct(parse_unit(u)) for u in batch.column("unit").to_pylist()]
        texts = [parse_text(t) for t in batch.column("source_text").to_pylist()]
        figures = [None if f is None or math.isinf(f) else f for f, _ in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("name"),
                batch.column("value"),
                pa.array(units, kinds),
                pa.array(figures, pa.float64()),
                pa.array([as_struct(u) for _, u in texts], kinds),
            ],
            ["id", "name", "value", "u", "figure", "t"],
        )


def candidates(records: DataFrame, measures: DataFrame, key: str = "input_id") -> DataFrame:
    """Records with an amount ``x`` in one of the units ``tried``, an array of (residual, place, factor).

    ``u`` and ``t`` are the parsed units of column and text.  Records without a
    figure, without any unit, or with a unit of another kind than their name
    has are left out.
    """
    id_type = records.schema[key].dataType.simpleString()
    unit_type = "struct<kind:string,currency:string,factor:double,scaled:boolean>"
    parsed = (
        records.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("id"), "name", F.col("value").cast("double").alias("value"), "unit", "source_text")
        .mapInArrow(statements, f"id {id_type}, name string, value double, u {unit_type}, figure double, t {unit_type}")
    )
    kinds = F.broadcast(measures.select("name", "quantity_kind", "common_unit").distinct())  # one row per measure, a fixed list
    known = parsed.join(kinds, "name")
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    kind, u, t = F.col("quantity_kind"), F.col("u"), F.when(F.col("t.kind") == F.col("quantity_kind"), F.col("t"))
    known = known.withColumns({"v": value, "t": t}).filter(u.isNull() | (u["kind"] == kind))
    x = F.coalesce("v", "figure")
    t = F.col("t")
    # candidate units of the value: the text's; the column's, with the text's scale if it has none; the column's alone
    merged = F.when(u.isNotNull() & ~u["scaled"] & t["scaled"], F.when(kind == "money", u["factor"] * t["factor"]).otherwise(t["factor"]))
    factors = F.filter(
        F.array(
            F.when(u.isNull() | F.col("v").isNull(), t["factor"]),
            merged,
            u["factor"],
            F.when(u.isNull() & F.col("v").isNotNull() & (kind == "money") & t["scaled"], F.lit(1.0)),
        ),
        lambda f: f.isNotNull(),
    )
    stated = F.abs(F.col("figure")) * t["factor"]
    gap = F.abs(F.ln(F.abs(x)) - F.ln(F.abs(F.col("figure"))))

    def residual(f):
        fits = F.when(t.isNotNull() & (stated > 0) & (F.abs(x) > 0), F.abs(F.ln(F.abs(x) * f) - F.ln(stated)))
        return F.coalesce(fits, F.when((F.abs(x) > 0) & (F.abs(F.col("figure")) > 0), gap), F.lit(0.0))

    tried = F.transform(factors, lambda f, i: F.struct(F.round(residual(f), 6).alias("residual"), i.alias("place"), f.alias("factor")))
    solved = known.withColumn("tried", tried).filter(x.isNotNull() & (F.size("tried") > 0)).withColumn("best", F.array_min("tried"))
    return solved.withColumn("x", x)


def unit_of(row_unit: str = "common_unit") -> F.Column:
    """The common unit of a candidate row: of money its own currency."""
    currency = F.coalesce(F.col("u.currency"), F.col("t.currency"), F.lit("USD"))
    return F.when(F.col("quantity_kind") == "money", currency).otherwise(F.col(row_unit))


def common_amounts(records: DataFrame, measures: DataFrame, key: str = "input_id") -> DataFrame:
    """``(id, common_unit, amount, residual, solutions)`` of the records whose amount can be told.

    ``solutions`` counts the different amounts that fit equally well.  Records
    without a figure, without any unit, or with a unit of another kind than
    their name has are left out, as are unknown names and null keys.  NaN and
    infinite values count as missing.  Repeated keys count once; an empty table
    gives no row; extra columns are ignored.
    """
    solved = candidates(records, measures, key)
    fits = F.filter("tried", lambda c: c["residual"] == F.col("best.residual"))
    equal = F.array_distinct(F.transform(fits, lambda c: F.round(c["factor"], 9)))
    return solved.select(
        "id",
        unit_of().alias("common_unit"),
        (F.col("x") * F.col("best.factor")).alias("amount"),
        F.col("best.residual").alias("residual"),
        F.size(equal).alias("solutions"),
    ).dropDuplicates(["id"])


#: Quantities a, b and c of one place and year, and the identity between their amounts in common units.
IDENTITIES = [
    ("eps_diluted", "shares_outstanding", "net_income", "product", 0.01),  # cents per share x shares = hundredths of the income
    ("dividend_per_share", "shares_outstanding", "dividends_paid", "product", 0.01),
    ("cost_of_revenue", "gross_margin", "revenue", "rest", 1e-4),  # what the costs leave of the revenue, in basis points
    ("operating_income", "operating_margin", "revenue", "share", 1e-4),
    ("net_income", "net_margin", "revenue", "share", 1e-4),
]


def joint_amounts(records: DataFrame, measures: DataFrame, place: list[str], key: str = "input_id", tolerance: float = 0.02) -> DataFrame:
    """``(place..., identity, ids, amounts, residual, solutions, not_unique, holds)`` of quantities tied by an identity.

    ``place`` names the columns that quantities must share; null places tie
    nothing.  Every three records of one place that have an identity's names
    give a row, so of several records of a name each meets all the others.
    Every combination of their candidate units is tried (a record has at most
    four); ``residual`` is the least distance of both sides in logarithms,
    ``solutions`` the number of combinations with other amounts that come as
    near, and ``holds`` whether the residual is within the tolerance.  Sides
    that are zero or of different signs fit nothing: without any fit amounts and
    residual are null.  Equal rows count once.
    """
    keyed = records.dropna(subset=[key, *place]).withColumn("placed", F.struct(F.col(key).alias("id"), *[F.col(p).alias(f"p{n}") for n, p in enumerate(place)]))
    roles = [(n, i, r) for i, identity in enumerate(IDENTITIES) for r, n in enumerate(identity[:3])]
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("i"), F.lit(r).alias("r")) for n, i, r in roles])
    solved = candidates(keyed, measures, "placed").filter(F.col("name").isin(sorted({n for n, _, _ in roles})))
    each = solved.select("id", "name", F.transform("tried", lambda c: F.col("x") * c["factor"]).alias("amounts")).distinct()
    taken = each.withColumn("part", F.explode(F.filter(parts, lambda p: p["name"] == F.col("name"))))
    held = materialise(taken.select(F.col("id.*"), F.col("part.i").alias("i"), F.col("part.r").alias("r"), "amounts"), "quantities")
    tie = ["i", *[f"p{n}" for n in range(len(place))]]
    full = held.groupBy(tie).agg(F.collect_set("r").alias("r")).filter(F.size("r") == 3).select(tie)
    tied = full
    for r, side in enumerate("abc"):
        tied = tied.join(held.filter(F.col("r") == r).select(*tie, F.struct("id", "amounts").alias(side)), tie)
    known = [F.element_at(F.array(*[F.lit(v) for v in x]), F.col("i") + 1) for x in zip(*[(f"{a}, {b}, {c}", kind, float(scale)) for a, b, c, kind, scale in IDENTITIES])]
    named = [F.col(f"p{n}").alias(p) for n, p in enumerate(place)]
    tied = tied.select(*named, "a", "b", "c", *[k.alias(n) for k, n in zip(known, ("identity", "kind", "scale"))])

    def residual(x, y, z):
        left = F.when(F.col("kind") == "product", x * y * F.col("scale")).when(F.col("kind") == "share", z * y * F.col("scale")).otherwise(z * (1 - y * F.col("scale")))
        right = F.when(F.col("kind") == "product", z).otherwise(x)
        return F.when((left > 0) & (right > 0) | (left < 0) & (right < 0), F.abs(F.ln(F.abs(left)) - F.ln(F.abs(right))))

    combine = lambda x, y, z: F.struct(F.round(residual(x, y, z), 6).alias("residual"), F.array(x, y, z).alias("amounts"))
    every = F.flatten(
        F.transform("a.amounts", lambda x: F.flatten(F.transform("b.amounts", lambda y: F.transform("c.amounts", lambda z: combine(x, y, z)))))
    )
    tried = tied.withColumn("tried", F.array_distinct(F.filter(every, lambda t: t["residual"].isNotNull())))
    tried = tried.withColumn("best", F.array_min("tried"))
    solutions = F.size(F.filter("tried", lambda t: t["residual"] == F.col("best.residual")))
    return tried.select(
        *place,
        "identity",
        F.array("a.id", "b.id", "c.id").alias("ids"),
        F.transform("best.amounts", lambda x: F.round(x, 2)).alias("amounts"),
        F.col("best.residual").alias("residual"),
        solutions.alias("solutions"),
        (solutions > 1).alias("not_unique"),
        F.coalesce(F.col("best.residual") <= tolerance, F.lit(False)).alias("holds"),
    )
