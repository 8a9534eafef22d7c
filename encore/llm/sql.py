"""Parts that several of this package's DuckDB statements share."""

from __future__ import annotations

#: CRC-32 of the UTF-8 bytes of a string f, where a table with the column `crc` (CRC_TABLE) is in scope.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: " \
          "('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::UBIGINT)), lambda a, b: " \
          "xor(a >> 8, crc[CAST(1 + (xor(a, b) & 255) AS BIGINT)])), 4294967295)"

#: For a WITH RECURSIVE: tab(crc), what CRC-32 makes of each byte.
CRC_TABLE = """k AS (
  SELECT range::UBIGINT AS n, range::UBIGINT AS c, 0 AS step FROM range(256)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM k WHERE step < 8),
tab AS (SELECT list(c ORDER BY n) AS crc FROM k WHERE step = 8)"""


def lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingle_components(n: int, similar: int) -> str:
    """CTEs up to `linked`: doc_id, n_shingles and component_id of documents by exact
    similarities of all pairs of sets that share a shingle."""
    shingle = " || ' ' || ".join(f"ws[i + {j}]" if j else "ws[i]" for j in range(n))
    return rf"""WITH RECURSIVE
w AS (
  SELECT doc_id, COALESCE(regexp_extract_all({lower('text')}, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {n - 2}), lambda i: {shingle}) END)) AS members FROM w),
c AS (SELECT row_number() OVER () AS cls, members, len(members) AS n, min(doc_id) AS own FROM s WHERE len(members) > 0 GROUP BY members),
f AS (SELECT cls, n, unnest(members) AS shingle FROM c),
l AS (
  SELECT a.cls AS u, b.cls AS v FROM f a JOIN f b ON a.shingle = b.shingle AND a.cls <> b.cls
    AND 100 * least(a.n, b.n) >= {similar} * greatest(a.n, b.n)
  GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= {similar} * (a.n + b.n - count(*))),
reach AS (SELECT cls AS u, cls AS v FROM c UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u),
root AS (SELECT u AS cls, min(own) AS component_id FROM reach JOIN c ON reach.v = c.cls GROUP BY u),
linked AS (
  SELECT doc_id, CAST(len(s.members) AS BIGINT) AS n_shingles, CASE WHEN len(s.members) = 0 THEN doc_id ELSE component_id END AS component_id
  FROM s LEFT JOIN c ON s.members = c.members LEFT JOIN root USING (cls))"""
