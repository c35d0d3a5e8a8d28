"""Cutting oversized texts at natural boundaries, with overlap.

One regular expression per size does the cutting: alternatives with bounded
quantifiers, ordered by the strength of the boundary they end on (paragraph,
line, sentence, clause, blank), each consuming as much as the limit allows,
with single characters as the fallback.  The overlap is found by looking back
from each cut with array functions.  Everything runs inside the JVM.

The work is linear in the length of a text.  Settings per filing are joined on,
so texts move once, and only those longer than the smallest limit in force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[ \t\n\r]"
DEFAULT_SIZE, DEFAULT_OVERLAP = 1200, 150
RUN = 256  # pieces whose lengths are summed at once


def settings_in_force(log: DataFrame) -> DataFrame:
    """``(doc_id, size, overlap)``: the latest usable complete run of each filing."""
    usable = (F.col("status") == "complete") & (F.col("chunk_overlap") >= 0) & (F.col("chunk_overlap") < F.col("chunk_size"))
    return (
        log.filter(usable & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.struct("updated_at", "chunk_size", "chunk_overlap")).alias("run"))
        .select("doc_id", F.col("run.chunk_size").alias("size"), F.col("run.chunk_overlap").alias("overlap"))
    )


def cutting_pattern(size: Column, overlap: Column) -> Column:
    """The regular expression for pieces of ``size`` characters, overlap included."""
    body = size - overlap  # what a piece may add to its overlap
    least = F.greatest(F.least((body / 2).cast("int"), body - 2), F.lit(0))  # no crumbs for the sake of a strong boundary

    def up_to(end: str, width: int) -> Column:
        return F.concat(F.lit(r"[\s\S]{"), least, F.lit(","), F.greatest(body - width, least), F.lit("}" + end))

    rest = F.concat(F.lit(r"[\s\S]{1,"), body, F.lit(r"}\z"))
    strong = F.concat_ws(
        "|",
        up_to(r"\n\n", 2),
        up_to(r"\n", 1),
        up_to(rf"[.!?…]{BLANK}", 2),
        up_to(rf"[,;:]{BLANK}", 2),
    )
    blank = F.concat(F.lit(r"[\s\S]{0,"), body - 1, F.lit("}" + BLANK))
    word = F.concat(F.lit(r"[^ \t\n\r]{1,"), size, F.lit(rf"}}(?={BLANK}|\z)"))
    characters = F.concat(F.lit(r"[\s\S]{1,"), body, F.lit("}"))
    return F.when(body >= 3, F.concat_ws("|", rest, strong, blank, word, characters)).otherwise(
        F.concat_ws("|", rest, blank, word, characters)
    )


def pieces_of(text: Column, size: Column, overlap: Column) -> Column:
    """Array of ``(start, piece, forced)`` for one text.

    ``start`` counts characters from 0 and includes the overlap; ``forced``
    marks a piece whose end is not at a boundary.  A null text gives null, an
    empty one an empty array.
    """
    none = F.expr("CAST(array() AS array<struct<start:int,piece:string,forced:boolean>>)")

    def placed(bodies: Column) -> Column:
        sizes = F.transform(bodies, lambda x: F.length(x))
        # running sums in two levels, so that no array is built anew for every piece
        sums = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
        runs = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / RUN).cast("int")), lambda g: sums(F.slice(z, g * RUN + 1, F.lit(RUN))))
        starts = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda g: sums(F.slice(t, F.lit(1), g)))

        def each(z: Column, before: Column) -> Column:
            def begin(i: Column) -> Column:
                group = F.floor((i - 1) / RUN).cast("int")
                return F.element_at(before, group + 1) + sums(F.slice(z, group * RUN + 1, i - 1 - group * RUN))

            return F.transform(F.sequence(F.lit(1), F.size(z)), lambda i: piece(bodies, i, begin(i)))

        return bind(sizes, lambda z: bind(runs(z), lambda t: bind(starts(t), lambda before: each(z, before))))

    def piece(bodies: Column, i: Column, begin: Column) -> Column:
        """The i-th body behind the end of the one before it; only it and its neighbours are looked at."""
        body = F.element_at(bodies, i)
        before = F.coalesce(F.try_element_at(bodies, F.nullif(i - 1, F.lit(0))), F.lit(""))
        earlier = F.coalesce(F.try_element_at(bodies, F.when(i > 2, i - 2)), F.lit(""))
        room = F.least(overlap, size - F.length(body), F.length(before))
        back = F.when(room > 0, F.right(before, room)).otherwise("")
        ahead = F.when(room < F.length(before), F.substring(before, F.length(before) - room, F.lit(1))).otherwise(F.right(earlier, F.lit(1)))
        joins_word = (room > 0) & (ahead != "") & ~ahead.rlike(BLANK)
        kept = F.when(joins_word & back.rlike(BLANK), F.regexp_replace(back, rf"\A[^ \t\n\r]*{BLANK}", "")).otherwise(back)
        follows = F.coalesce(F.try_element_at(bodies, i + 1), F.lit(""))
        cut = ~F.right(body, F.lit(1)).rlike(BLANK) & F.left(follows, F.lit(1)).rlike(r"[^ \t\n\r]")
        return F.struct((begin - F.length(kept)).alias("start"), F.concat(kept, body).alias("piece"), cut.alias("forced"))

    found = F.regexp_extract_all(text, cutting_pattern(size, overlap), F.lit(0))
    return bind(found, lambda bodies: F.when(F.size(bodies) > 0, placed(bodies)).when(F.size(bodies) == 0, none))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_oversized(rows: DataFrame, log: DataFrame, key: str = "chunk_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size, pieces)`` of the texts longer than their filing's size.

    Repeated keys count once.  Null texts, null keys and texts within the size
    have no row; a filing without a usable run (or a null filing) has size 1200
    and overlap 150; negative overlaps, overlaps not below the size and null
    settings are unusable.  Extra columns are ignored.
    """
    settings = settings_in_force(log).withColumnRenamed("doc_id", "filing")
    smallest = settings.agg(F.least(F.coalesce(F.min("size"), F.lit(DEFAULT_SIZE)), F.lit(DEFAULT_SIZE))).first()[0]
    texts = rows.select(F.col(key).alias("key"), F.col(doc).alias("doc"), F.col(text).alias("text")).filter(
        F.col("key").isNotNull() & (F.length("text") > smallest)
    )
    sized = texts.join(settings, F.col("doc") == F.col("filing"), "left").select(
        "key",
        "text",
        F.coalesce("size", F.lit(DEFAULT_SIZE)).alias("size"),
        F.coalesce("overlap", F.lit(DEFAULT_OVERLAP)).alias("overlap"),
    )
    long_ = sized.filter(F.length("text") > F.col("size")).dropDuplicates(["key"])
    return long_.select("key", "size", pieces_of(F.col("text"), F.col("size"), F.col("overlap")).alias("pieces"))
