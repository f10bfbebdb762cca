"""SQL that gives the rows of those queries which SQL can express on the tables."""

from __future__ import annotations

# every 50-byte string with its first document; runs of covered bytes; what is left between them
OP4_REPEATED_STRINGS = r"""
WITH bytes AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents
), sized AS (
    SELECT doc_id, digits, length(digits) // 2 AS n_bytes FROM bytes
), shifted AS (
    SELECT doc_id, k, regexp_extract_all(substr(digits, 2 * k + 1), '.{100}') AS parts
    FROM (SELECT doc_id, digits, unnest(range(50)) AS k FROM sized)
), starts AS (
    SELECT doc_id, unnest(parts) AS part, k + 1 + 50 * unnest(range(len(parts))) AS pos FROM shifted
), strings AS (
    SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY part) AS first FROM starts
), hits AS (
    SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before
    FROM strings WHERE first < doc_id
), marked AS (
    SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + 50 THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY pos) AS run
    FROM hits
), runs AS (
    SELECT doc_id, run, min(pos) AS low, max(pos) + 50 AS high FROM marked GROUP BY doc_id, run
), between_runs AS (
    SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 1) AS left_from
    FROM runs
), kept AS (
    SELECT r.doc_id, count(*) AS n_spans, sum(r.high - r.low) AS n_removed, max(r.high) AS tail,
        string_agg(substr(s.digits, 2 * r.left_from - 1, 2 * (r.low - r.left_from)), '' ORDER BY r.low)
            AS head
    FROM between_runs r JOIN sized s ON r.doc_id = s.doc_id
    GROUP BY r.doc_id
)
SELECT s.doc_id, CAST(s.n_bytes AS BIGINT) AS n_bytes,
    CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(k.head, '') || substr(s.digits, 2 * coalesce(k.tail, 1) - 1))) AS kept_sha256
FROM sized s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

# common shingles counted by a join on the shingle; smallest id reached by a recursion over links
OP7_MINHASH = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[pos : pos + 2], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS pos FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS one, b.doc_id AS other, count(*) AS both_have
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT one, other FROM common
    JOIN sizes x ON x.doc_id = one JOIN sizes y ON y.doc_id = other
    WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)
), reached AS (
    SELECT doc_id, doc_id AS node FROM documents
    UNION
    SELECT r.doc_id, l.other FROM reached r JOIN links l ON l.one = r.node
), smallest AS (
    SELECT doc_id, min(node) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN smallest m ON m.doc_id = d.doc_id
"""

# base 32 takes five bits a letter: twenty bits, four letters, of five hexadecimal digits
OP9_WARC_INDEX = r"""
WITH payloads AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), chosen AS (
    SELECT page_id, payload, sha1(payload) AS digits,
        max(page_id) OVER (PARTITION BY payload) AS response
    FROM payloads
)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(digits, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31),
        1)), '') AS payload_digest,
    CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> response THEN response END AS refers_to
FROM chosen
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_repeated_strings": OP4_REPEATED_STRINGS,
        "op7_minhash": OP7_MINHASH,
        "op9_warc_index": OP9_WARC_INDEX,
    }
