"""Importance resampling towards a target: hashed n-gram buckets, Gumbel top k.

A word's payload is its CRC-32 and its length in bytes. A task keeps a dictionary
of the words it has met more than once, delimiter-bounded, in an Aho-Corasick
automaton; one scan of a piece of text emits the payload of each such word where
it ends. Words that are not in the dictionary get theirs from their bytes, so the
dictionary only saves work. Payloads compose: the CRC of "a b" is the CRC of "a "
moved on by the length of b (a linear map of 32 bits, a table per length) xor the
CRC of b. So n-gram buckets come from payloads of neighbours, without text.

Bucket counts of the corpus and of the target (at most `buckets` rows each) give a
gain per bucket; a document's weight is the mean gain of its features, its score
adds Gumbel noise drawn from its id, and the highest scores are drawn without
replacement. Positions come from ranges of the scores, so no task sorts them all.

Cases: null and empty texts have no features and weight 0; a very long text is a
piece of its own; rows of equal ids have equal noise and are drawn as rows of
their own, a null id counts as '' and comes last among equal scores; an empty
corpus or target has counts of 0 (gains stay finite); all kept columns stay,
new names get underscores before them where they are taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.llm.bytewords import ALNUM, LOWER, Piece, pieces
from encore.llm.common import cut, free_name
from encore.llm.sql import CRC_SQL, CRC_TABLE, lower
from encore.operators.ranking import with_position

BUCKETS = 10_000
#: Words a task's automaton holds, and words it counts before it forgets those met once.
DICTIONARY, COUNTED = 5_000, 100_000
SHORT = 64                                   # lengths with a table of their own in `_ADVANCE`


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))   # the CRC-32 polynomial
    return c


_BYTE = _byte_table()
#: Entry [j, b] of a map: what it makes of byte b at place j of a CRC.
_SAME = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][(c >> np.uint32(8)) & 255] ^ table[2][(c >> np.uint32(16)) & 255] ^ table[3][c >> np.uint32(24)]


@lru_cache(maxsize=4096)
def _advance(length: int) -> np.ndarray:
    """The map that moves a CRC on by `length` bytes."""
    if not length:
        return _SAME
    if length == 1:
        return (_SAME >> np.uint32(8)) ^ _BYTE[_SAME & 255]
    half = _advance(length // 2)
    whole = _apply(half, half)
    return _apply(_advance(1), whole) if length % 2 else whole


def compose(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of left + right, from the CRCs of both and the lengths of the right parts."""
    short = np.stack([_advance(i) for i in range(SHORT)])
    n = np.minimum(length, SHORT - 1)
    out = short[n, 0, left & 255] ^ short[n, 1, (left >> np.uint32(8)) & 255] \
        ^ short[n, 2, (left >> np.uint32(16)) & 255] ^ short[n, 3, left >> np.uint32(24)]
    for i in np.unique(length[length >= SHORT]):
        at = length == i
        out[at] = _apply(_advance(int(i)), left[at])
    return out ^ right


class Dictionary:
    """Payloads of the words met so far that are worth an automaton."""

    def __init__(self, most: int = DICTIONARY):
        self.most, self.met, self.pieces, self.due = most, Counter(), 0, 1
        self.automaton, self.known, self.crc = None, {}, np.zeros(0, np.uint32)

    def _learn(self) -> None:
        """Takes in what was met more than once, and builds the automaton anew; after
        each doubling of the pieces read."""
        new = [w for w, n in self.met.most_common(self.most - len(self.known)) if n > 1]
        self.met.clear()
        if not new:
            return
        self.known |= dict(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.crc = np.array([crc32(w) for w in self.known], np.uint32)
        self.automaton = ahocorasick.Automaton()
        for w, i in self.known.items():
            self.automaton.add_word(f" {w.decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def payloads(self, p: Piece) -> np.ndarray:
        """The CRC of each word of a piece."""
        doc = p.doc
        crc, left = np.zeros(len(doc), np.uint32), np.ones(len(doc), bool)
        if self.automaton is not None and len(doc):
            # one delimiter for each byte between words, and one around each text
            line = np.full(len(p.buf) + p.n + 1, 0x20, np.uint8)
            line[np.arange(len(p.buf)) + np.repeat(np.arange(1, p.n + 1), np.diff(p.at))] = np.where(ALNUM[p.buf], p.buf, 0x20)
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(line.tobytes().decode("latin-1"))), np.int64)
            word = np.searchsorted(p.ends + doc + 1, hits[0::2])
            crc[word], left[word] = self.crc[hits[1::2]], False
        raw = p.buf.tobytes()
        rest = np.flatnonzero(left)
        words = [raw[a:b] for a, b in zip(p.starts[rest].tolist(), p.ends[rest].tolist(), strict=True)]
        crc[rest] = [crc32(w) for w in words]
        if len(self.known) < self.most:
            self.met.update(words)
            if len(self.met) > COUNTED:
                self.met = Counter({w: n for w, n in self.met.items() if n > 1})
            self.pieces += 1
            if self.pieces >= self.due:
                self.due *= 2
                self._learn()
        return crc


def features(p: Piece, dictionary: Dictionary, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every run of 1 to `longest` words, in no order."""
    doc, length, crc = p.doc, p.ends - p.starts, dictionary.payloads(p)
    space = np.full(len(crc), crc32(b" "), np.uint32)
    spaced = compose(crc, space, np.ones(len(crc), np.int64))       # "word "
    gram, gram_length = crc, length
    docs, out = [doc], [crc]
    for n in range(2, longest + 1):
        m = max(len(doc) - n + 1, 0)
        # the first word and a space before the n - 1 words after it
        gram = compose(spaced[:m], gram[1:m + 1], gram_length[1:m + 1])
        gram_length = length[:m] + 1 + gram_length[1:m + 1]
        one = doc[:m] == doc[n - 1:n - 1 + m]
        docs.append(doc[:m][one])
        out.append(gram[one])
    return np.concatenate(docs), (np.concatenate(out) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(df: DataFrame, text: str = "text", longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of a table; a task emits each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, dictionary = np.zeros(buckets, np.int64), Dictionary()
        for b in batches:
            for p in pieces(b.column(0), ALNUM, LOWER):
                total += np.bincount(features(p, dictionary, longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return df.select(F.col(text).cast("string")).mapInArrow(run, "bucket long, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of target to source, per bucket, floored; from
    two tables of counts, of at most `buckets` rows each."""
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    s, t = source.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    n = cut(every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"]))
    all_s, all_t = n.agg(F.sum("s"), F.sum("t")).first()
    d = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("double")
    ratio = d(F.col("t") + 1) * d(all_s + buckets) / (d(F.col("s") + 1) * d(all_t + buckets))
    rows = n.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.gain
    return out


def weigh(df: DataFrame, gain: np.ndarray, text: str = "text", longest: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and n_words, n_features and weight, the floored mean gain."""
    names = []
    for c in ("n_words", "n_features", "weight"):
        names.append(free_name(df.select(*keep), c))
    src = df.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = Dictionary()
        for b in batches:
            for p in pieces(b.column(0), ALNUM, LOWER):
                doc, bucket = features(p, dictionary, longest, buckets)
                n = np.bincount(doc, minlength=p.n)
                total = np.bincount(doc, gain[bucket], p.n).astype(np.int64)
                own = b.slice(p.first, p.n)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[1:], pa.array(np.diff(p.word_at)), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    names=[*b.schema.names[1:], *names])

    return src.mapInArrow(run, T.StructType([*src.schema.fields[1:], *(T.StructField(c, T.LongType()) for c in names)]))


def noise(doc_id: str, seed: str) -> Column:
    """Gumbel noise in thousandths, from 32 bits of a SHA-256 of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(weighed: DataFrame, percent: int = 25, min_words: int = 20, seed: str = "7", doc_id: str = "doc_id",
             n_words: str = "n_words", weight: str = "weight") -> DataFrame:
    """Adds score, and rank 1, 2, 3... of the highest `percent` of the rows with
    `min_words` words; null for rows that are not drawn."""
    score, rank = free_name(weighed, "score"), free_name(weighed, "rank")
    rows = cut(weighed.withColumn(score, (F.col(weight) + noise(doc_id, seed)).cast("long")))
    enough = F.col(n_words) >= min_words
    every = free_name(rows, "all_rows")
    placed = with_position(rows.filter(enough), [F.desc(score), F.col(f"`{doc_id}`").asc_nulls_last()], (), rank, every)
    drawn = F.col(rank) <= F.floor(F.col(every) * percent / 100)
    return placed.withColumn(rank, F.when(drawn, F.col(rank))).drop(every) \
        .unionByName(rows.filter(~enough).withColumn(rank, F.lit(None).cast("long")))


def importance(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = 2, buckets: int = BUCKETS,
               keep: tuple[str, ...] = ("doc_id",), **params) -> DataFrame:
    """Documents of `docs` weighed and drawn towards the texts of `target`."""
    count = lambda df: bucket_counts(df, text, longest, buckets)
    return resample(weigh(docs, gains(count(docs), count(target), buckets), text, longest, keep), **params)


ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
texts AS (
  SELECT true AS doc, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark),
w AS (
  SELECT row_number() OVER () AS r, doc, doc_id, COALESCE(regexp_extract_all(
    {lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM texts),
g AS (
  SELECT r, doc, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
per AS (SELECT r, doc, f, count(*) AS n FROM g GROUP BY ALL),
b AS (SELECT f, CAST({CRC_SQL} % 10000 AS BIGINT) AS bucket FROM (SELECT DISTINCT f FROM per), tab),
c AS (SELECT bucket, sum(n) FILTER (WHERE doc) AS s, sum(n) FILTER (WHERE NOT doc) AS t FROM per JOIN b USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(COALESCE(t, 0) + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE)
    / (CAST(COALESCE(s, 0) + 1 AS DOUBLE) * CAST(COALESCE(sum(t) OVER (), 0) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM c),
m AS (SELECT r, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight
      FROM per JOIN b USING (f) JOIN gain USING (bucket) WHERE doc GROUP BY r),
x AS (
  SELECT w.r, doc_id, len(ws) AS words, CAST(len(ws) + greatest(len(ws) - 1, 0) AS BIGINT) AS n_features, COALESCE(weight, 0) AS weight,
    CAST(('0x' || substr(sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM w LEFT JOIN m USING (r) WHERE doc),
y AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
             count(*) OVER (PARTITION BY words >= 20) AS every FROM y)
SELECT doc_id, n_features, weight, score,
       CAST(CASE WHEN words >= 20 AND place <= (25 * every) // 100 THEN place END AS BIGINT) AS rank
FROM z
"""
