"""DuckDB counterparts of the queries of this package that SQL can express."""

ORACLE: dict[str, str] = {
    "op8_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body FROM pages
        ), q AS (
            SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
        ), r AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM r
    """,
    "op11_line_dedup": """
        WITH d AS (
            SELECT row_number() OVER () AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), l AS (
            SELECT doc, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d
        ), k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
        ), gone AS (
            SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= 10
        ), m AS (
            SELECT k.*, gone.key IS NOT NULL AS dropped FROM k LEFT JOIN gone USING (key)
        )
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc
    """,
}
