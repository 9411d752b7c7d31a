"""SQL that DuckDB runs for those registered operators that SQL can express: the contracts stated plainly, not the methods."""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The least id that links (a, b), in both directions, connect to an id of `nodes`.
REACHED = """
reached(id, low) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT l.b, r.low FROM reached r JOIN links l ON l.a = r.id WHERE r.low < l.b
),
least AS (SELECT id, min(low) AS low FROM reached GROUP BY id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, payload, max(page_id) OVER (PARTITION BY payload) AS last, CAST(CAST(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
        16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT)
    AS INT), 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM q
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (
    SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9
),
nodes AS (SELECT vec_id AS id FROM v),
{REACHED}
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, low AS component_id, v.vec_id = low AS kept FROM v JOIN least ON id = v.vec_id
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=f"coalesce({LOWER}, '')")} AS words FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 2, 2)), lambda i: array_to_string(words[i : i + 3], ' '))) AS shingle
    FROM w WHERE len(words) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
close AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
links AS (SELECT a, b FROM close UNION ALL SELECT b, a FROM close),
nodes AS (SELECT doc_id AS id FROM documents),
{REACHED}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, low AS component_id FROM least LEFT JOIN n ON n.doc_id = id
"""

WINDOWS = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS seq FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
judged AS (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS nth FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM judged WHERE nth > 1),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL = {"op1_warc_packages": WARC, "op6_multi_index": EMBEDDINGS, "op7_jaccard_join": JACCARD, "op8_repeated_windows": WINDOWS}
