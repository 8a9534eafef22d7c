"""Periodic runs of words, by recursive frequency splitting.

A run is a longest stretch of words with smallest period q (words q apart are
equal) and at least max(`least`, `repeats` * q) words. Each of its words occurs
`repeats` times or more within it. So a word that is rarer than that in its
segment is in no run: the segment is split there, and the parts are counted
anew, until no word is too rare. What survives is scanned for lags, one octave
[w, 2w) at a time: in a run of period q every window of 2w words comes again
exactly q words later, and no earlier (else q would not be the smallest period),
so a run is one stretch of positions whose next equal window is q away, and
nothing else is. Windows that do not come again are left out of the next octave.
A text of m words takes some m log m steps an octave, and never m lags.

Words and windows are compared by 64-bit hashes.

Cases: null and empty texts have no words, no runs, and an empty (null: null)
collapsed text; a very long text is a piece of its own, in memory that follows
its length; equal rows get equal results, each row by itself; where runs
overlap, a word goes when any of them drops it; an empty table gives an empty
one. All columns stay; `runs` gets underscores before it where that is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.llm.bytewords import NOT_SPACE, Piece, mix, pieces
from encore.llm.common import free_name
from encore.llm.sql import CRC_SQL, CRC_TABLE

LEAST, REPEATS = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
U = np.uint64
RUNS = "array<struct<start: long, length: long, period: long>>"


def _positions(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All positions of the stretches, one after another."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def segments(words: np.ndarray, start: np.ndarray, end: np.ndarray, least: int = LEAST,
             repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of the given stretches that can hold runs:
    in each, every word occurs `repeats` times. `words` are numbers from 0."""
    kinds = int(words.max(initial=0)) + 1
    stable: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        long = end - start >= max(least, repeats)
        start, end = start[long], end[long]
        if not len(start):
            break
        n = end - start
        own = np.repeat(np.arange(len(n)), n)
        pos = _positions(start, n)
        _, kind, times = np.unique(own * kinds + words[pos], return_inverse=True, return_counts=True)
        rare = times[kind] < repeats
        split = np.bincount(own[rare], minlength=len(n)) > 0
        stable.append((start[~split], end[~split]))
        left = split[own] & ~rare
        pos, own = pos[left], own[left]
        # parts are stretches of neighbouring positions of one segment
        new = np.ones(len(pos), bool)
        new[1:] = (pos[1:] != pos[:-1] + 1) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pos)) - 1
        start, end = pos[first], (pos[last] + 1 if len(first) else pos[first])
    start = np.concatenate([s for s, _ in stable]) if stable else np.zeros(0, np.int64)
    end = np.concatenate([e for _, e in stable]) if stable else np.zeros(0, np.int64)
    order = np.argsort(start)
    return start[order], end[order]


def lag_scan(words: np.ndarray, start: np.ndarray, end: np.ndarray, least: int = LEAST,
             repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run in the segments, in that order."""
    n = end - start
    pos, stop = _positions(start, n), np.repeat(end, n)
    # windows of different segments are never equal
    h = mix(words[pos].astype(U) + np.repeat(start, n).astype(U) * U(0x9E3779B97F4A7C15))
    size = np.repeat(n, n)
    again = np.ones(len(pos), bool)              # the window of w words from here comes again
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    w = 1
    while True:
        fits = size >= max(least, repeats * w)   # a shorter segment has no run with such a period
        if not fits.all():
            pos, stop, h, size, again = pos[fits], stop[fits], h[fits], size[fits], again[fits]
        if not len(pos):
            break
        both = again.copy()
        both[:len(pos) - w] &= again[w:]
        at = np.flatnonzero(both & (pos + 2 * w <= stop))
        h2 = np.zeros(len(pos), U)
        h2[at] = mix(h[at] * U(0xD1342543DE82EF95) + h[at + w])
        order = at[np.argsort(h2[at], kind="stable")]
        equal = h2[order[1:]] == h2[order[:-1]]
        next_ = np.zeros(len(pos), np.int64)     # how far the next equal window is; 0: there is none
        here, there = order[:-1][equal], order[1:][equal]
        next_[here] = there - here
        again = np.zeros(len(pos), bool)
        again[here] = again[there] = True
        q = np.where((next_ >= w) & (next_ < 2 * w), next_, 0)
        change = np.flatnonzero(np.diff(q, prepend=0, append=0))
        a, b = change[:-1], change[1:]
        a, b = a[q[a] > 0], b[q[a] > 0]
        period = q[a]
        length = b - a - 1 + 2 * w + period
        run = length >= np.maximum(least, repeats * period)
        found.append((pos[a[run]], length[run], period[run]))
        h, w = h2, 2 * w
    s, length, q = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    order = np.lexsort((q, s))
    return s[order], length[order], q[order]


def runs_of(p: Piece, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all texts of a piece; starts are word numbers of the piece."""
    _, words = np.unique(p.hashes(), return_inverse=True)
    words = words.astype(np.int64)
    start, end = segments(words, p.word_at[:-1], p.word_at[1:], least, repeats)
    return lag_scan(words, start, end, least, repeats)


def _joined(p: Piece, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text, one space apart: bytes and offsets."""
    a, n = p.starts[keep], (p.ends - p.starts)[keep] + 1
    out = p.buf[np.minimum(_positions(a, n), max(len(p.buf) - 1, 0))]
    out[np.cumsum(n) - 1] = 0x20
    doc = p.doc[keep]
    size = np.bincount(doc, n, p.n).astype(np.int64)
    last = np.zeros(len(out), bool)              # the space after a text's last word goes
    last[np.cumsum(size)[size > 0] - 1] = True
    return out[~last], np.concatenate([[0], np.cumsum(size - (size > 0))])


def collapse(df: DataFrame, text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """`df` with the texts collapsed (of each run the first period stays; words
    one space apart) and `runs`: start, length and period by start and period."""
    if repeats < 3:
        raise ValueError("a run must hold its period three times at least")
    name, where = free_name(df, "runs"), df.columns.index(text)
    schema = T.StructType([T.StructField(f.name, T.StringType() if i == where else f.dataType) for i, f in enumerate(df.schema)]
                          + [T.StructField(name, T.DataType.fromDDL(RUNS))])
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column(where), NOT_SPACE):
                s, length, q = runs_of(p, least, repeats)
                doc = np.searchsorted(p.word_at, s, "right") - 1
                gone = np.zeros(len(p.starts) + 1, np.int64)
                np.add.at(gone, s + q, 1)
                np.add.at(gone, s + length, -1)
                data, at = _joined(p, np.cumsum(gone[:-1]) == 0)
                own = b.slice(p.first, p.n)
                nulls = own.column(where).is_null().to_numpy(zero_copy_only=False)
                texts = pa.array([None if null else data[i:j].tobytes().decode()
                                  for null, i, j in zip(nulls, at[:-1], at[1:], strict=True)], pa.string())
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc, np.arange(p.n + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(s - p.word_at[doc]), pa.array(length), pa.array(q)], fields=list(kind)))
                columns = list(own.columns)
                columns[where] = texts
                yield pa.RecordBatch.from_arrays([*columns, runs], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, in a tenth of the documents (by CRC of the id) with a run: from
    word a on, the p words from there over and over. Null ids count as ''."""
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), 0)
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    rest = n - a
    p = (F.lit(1) + F.floor(rest / (F.lit(3) + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int")))
    whole = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(cycle, F.lit(1), rest)), " ")
    return F.when((h % 10 == 0) & F.col(text).rlike(WORD), whole).otherwise(F.col(text))


def digest(collapsed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of runs, the run with most periods (the first of
    equals), and SHA-256 of all runs and of the collapsed text."""
    runs = F.col(collapsed.columns[-1])
    kind = "struct<start: long, length: long, period: long>"
    best = F.reduce(runs, F.lit(None).cast(kind), lambda top, r: F.when(
        top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size(runs) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return collapsed.select(F.col(doc_id).alias("doc_id"), F.size(runs).cast("long").alias("n_runs"), best.alias("best"),
                            sha(listed).alias("runs_sha256"), sha(F.coalesce(F.col(text), F.lit(""))).alias("collapsed_sha256")) \
        .select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
                "runs_sha256", "collapsed_sha256")


#: All pairs of equal words, their distances as lags, and stretches of one lag.
ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (
  SELECT row_number() OVER () AS r, doc_id, COALESCE(CAST(doc_id AS VARCHAR), '') AS f,
         COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
c AS (SELECT r, doc_id, ws, CAST(len(ws) AS BIGINT) AS n, CAST({CRC_SQL} AS BIGINT) AS h FROM d, tab),
p AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM c),
q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM p),
x AS (
  SELECT r, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[1 + a + (i - a) % p] ELSE ws[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM q)),
lag AS (SELECT u.r, u.i, v.i - u.i AS q FROM x u JOIN x v ON u.r = v.r AND u.word = v.word AND v.i > u.i AND (v.i - u.i) * 4 <= u.n),
isl AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM lag),
stretch AS (SELECT r, q AS period, min(i) AS start, count(*) + q AS length FROM isl GROUP BY r, q, g
            HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, start, length, min(period) AS period FROM stretch GROUP BY r, start, length),
best AS (
  SELECT r, count(*) AS n_runs, arg_min(struct_pack(start := start, length := length, period := period), place) AS b,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM run)
  GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, COALESCE(n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length,
       CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
       sha256(COALESCE(lines, '')) AS runs_sha256, sha256(COALESCE(text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
