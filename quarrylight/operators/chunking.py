"""Pages to chunks: layout tables, recursive splitting and chunk ids."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T

SEPARATORS = ["\n\n", "\n", ". ", "; ", ", ", " ", ""]  # strongest first
SHORT_TAIL = 300  # a last chunk below this joins the one before it


def split_recursively(text: str, size: int, overlap: int, separators: list[str] | None = None) -> list[str]:
    """Parts of at most ``size`` characters, cut at the strongest separator that does, with overlap."""
    separators = SEPARATORS if separators is None else separators
    sep = next(s for s in separators if s == "" or s in text)
    finer = separators[separators.index(sep) + 1 :]
    raw = list(text) if sep == "" else text.split(sep)
    parts = [p if i == 0 or sep == "" else sep + p for i, p in enumerate(raw)]
    out: list[str] = []
    run: deque[str] = deque()
    held = 0  # characters in the run

    def close() -> None:
        nonlocal held
        if run:
            out.append("".join(run))
            run.clear()
            held = 0

    for part in (p for p in parts if p):
        if len(part) > size and finer:
            close()
            out += split_recursively(part, size, overlap, finer)
            continue
        if run and held + len(part) > size:
            out.append("".join(run))
            while run and (held > overlap or held + len(part) > size):
                held -= len(run.popleft())
        run.append(part)
        held += len(part)
    close()
    return out


def chunk_texts(text: str, size: int, overlap: int) -> list[str]:
    """Stripped parts of a text; a short last part joins its predecessor."""
    parts = [p.strip() for p in split_recursively(text.strip(), size, overlap)] if text.strip() else []
    parts = [p for p in parts if p]
    if len(parts) > 1 and len(parts[-1]) < SHORT_TAIL:
        parts[-2:] = [f"{parts[-2]}\n\n{parts[-1]}"]
    return parts


def chunk_pages(pages: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Chunks ``(chunk_id, doc_id, page, section, content_type, text)`` of pages.

    ``pages`` has ``doc_id, page, section, text, tables`` (array of strings or
    null).  Every table with text is one chunk, the page's text is split.
    Null or blank texts and tables give none; null pages and ids are left out;
    an overlap not below the size is an error.
    """
    if overlap >= size:
        raise ValueError("the overlap must be below the size")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [chunk_texts(t or "", size, overlap) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.string()))], [*batch.schema.names, "parts"])

    base = pages.filter(F.col("doc_id").isNotNull() & F.col("page").isNotNull()).select(
        "doc_id", "page", F.coalesce("section", F.lit("Unknown")).alias("section"), "text", "tables"
    )
    kept = F.filter(F.coalesce("tables", F.expr("CAST(array() AS array<string>)")), lambda t: F.trim(t) != "")
    prefix = T.chunk_prefix(F.col("doc_id"), F.col("page"))
    table_rows = base.select("doc_id", "page", "section", F.posexplode_outer("tables").alias("i", "text")).filter(F.trim("text") != "")
    tables = table_rows.select(
        F.concat(prefix, F.lit("_t"), F.format_string("%03d", "i")).alias("chunk_id"), "doc_id", "page", "section", F.lit("table").alias("content_type"), F.trim("text").alias("text")
    )
    counted = base.withColumn("n_tables", F.size(kept)).select("doc_id", "page", "section", "text", "n_tables")
    names = "doc_id string, page int, section string, text string, n_tables int, parts array<string>"
    narrative = counted.withColumn("page", F.col("page").cast("int")).mapInArrow(split, names)
    each = narrative.withColumn("content_type", T.content_type(F.col("text"), F.col("section"))).select(
        "doc_id", "page", "section", "content_type", "n_tables", F.posexplode("parts").alias("i", "text")
    )
    texts = each.select(
        F.concat(prefix, F.lit("_n"), F.format_string("%03d", "n_tables"), F.lit("_c"), F.format_string("%03d", "i")).alias("chunk_id"),
        "doc_id", "page", "section", "content_type", "text",
    )
    every = tables.unionByName(texts)
    found = F.when(F.col("section").isin("", "Unknown"), F.coalesce(T.body_section(F.col("text")), F.col("section"))).otherwise(F.col("section"))
    return every.withColumn("section", found)


def separate_tables(pages: DataFrame) -> DataFrame:
    """Splits a page's mark-up into narrative ``text`` and ``tables`` by layout boxes.

    ``pages`` has ``markdown`` and ``boxes``, an array of structs ``(class,
    start, stop)`` in any order; overlaps are clipped at what came before; null
    boxes leave everything narrative.
    """
    ordered = F.array_sort(F.transform(F.coalesce("boxes", F.expr("CAST(array() AS array<struct<class:string,start:int,stop:int>>)")), lambda b: F.struct(b["start"], b["stop"], b["class"])))
    empty = F.expr("named_struct('at', 0, 'text', '', 'tables', CAST(array() AS array<string>))")

    def take(acc, b):
        start, stop = F.greatest(acc["at"], b["start"]), F.greatest(acc["at"], b["stop"])
        before = F.substring("markdown", acc["at"] + 1, start - acc["at"])
        inside = F.substring("markdown", start + 1, stop - start)
        is_table = b["class"] == "table"
        return F.struct(
            stop.alias("at"),
            F.concat(acc["text"], before, F.when(is_table, "").otherwise(inside)).alias("text"),
            F.when(is_table & (F.trim(inside) != ""), F.concat(acc["tables"], F.array(F.trim(inside)))).otherwise(acc["tables"]).alias("tables"),
        )

    swept = pages.withColumn("swept", F.aggregate(ordered, empty, take))
    rest = F.substring("markdown", F.col("swept.at") + 1, F.length("markdown"))
    return swept.withColumn("text", F.concat(F.col("swept.text"), rest)).withColumn("tables", F.col("swept.tables")).drop("swept")
