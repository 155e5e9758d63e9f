"""DuckDB SQL of the opN_ queries that SQL can express."""

FAIR_MIX = r"""
WITH q AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM q GROUP BY source
), w AS (
    SELECT *, CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s
), r AS (
    SELECT *, CAST(cap AS DOUBLE) / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w
), l AS (
    SELECT *, (1.5 * total - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
              / CAST(sum(weight) OVER (ORDER BY ratio, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r
), t AS (
    SELECT *, min(CASE WHEN cap > level * weight THEN row(ratio, pos, level) END) OVER () AS open FROM l
), aims AS (
    SELECT source, source_size, pos, CASE WHEN open IS NULL OR row(ratio, pos) < row(open[1], open[2]) THEN CAST(cap AS DOUBLE) ELSE open[3] * weight END AS target FROM t
), c AS (
    SELECT q.doc_id, q.size, q.h, a.pos, a.source_size, a.target, e,
           CASE WHEN a.target > 0 THEN CAST(e * a.source_size + sum(q.size) OVER (PARTITION BY a.pos, e ORDER BY q.h, q.doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / a.target ELSE 0.0 END AS finish
    FROM q JOIN aims a ON q.source IS NOT DISTINCT FROM a.source, (VALUES (0), (1)) v(e)
), g AS (
    SELECT *, sum(size) OVER (ORDER BY finish, pos, e, h, doc_id ROWS UNBOUNDED PRECEDING) <= 1.5 * (SELECT sum(source_size) FROM s) AS inside FROM c
)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN inside THEN size ELSE 0 END) AS BIGINT) AS taken
FROM g GROUP BY doc_id, size, source_size, target
"""

CHAT_FORMAT = """
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(2 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), '|', '&vert;')) + 2
                + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + 7) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_fair_mix": FAIR_MIX, "op8_chat_format": CHAT_FORMAT}
