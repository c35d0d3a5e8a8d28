"""Equivalent SQL of the training-data queries, where SQL can express them on whole tables."""

SQL: dict[str, str] = {
    "p5_found": """
        WITH runs AS (
            SELECT doc_id, max(struct_pack(u := updated_at, s := chunk_size, o := chunk_overlap)) AS run
            FROM ingest_documents
            WHERE status = 'complete' AND chunk_overlap >= 0 AND chunk_overlap < chunk_size GROUP BY doc_id),
        texts AS (SELECT DISTINCT chunk_id, doc_id, text FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
        sized AS (SELECT chunk_id, text, coalesce(run.s, 1200) AS size FROM texts LEFT JOIN runs USING (doc_id))
        SELECT chunk_id, CASE WHEN list_max(list_transform(
            string_split_regex(text, '[ \\t\\n\\r]'), lambda x: length(x))) > size THEN 'forced' ELSE 'natural' END AS cut
        FROM sized WHERE length(text) > size""",
}
