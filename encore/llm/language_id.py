"""Language identification with labelled spans.

A word's score in a language is the sum of log probabilities of its byte
trigrams (hashed to `cells`), learned from texts whose language is known. Words are
runs of letters and their marks; quotes, dashes, digits and signs are not part of
them, in any script. The script of a word, from the Unicode block of its first
letter, narrows the candidates to languages that are written in it. Viterbi over the words of a text, with a penalty for every
switch, gives each word a language: runs of one language are spans, and the
language with most letters is the text's.

Learning counts the trigrams of all texts with a known language: a task adds them
up per language, at most HELD languages at a time, and what meets on the driver is
one table of cells and languages, whatever the number of texts.

Cases: a null text, or one without a letter, is `und` with score 0 and no spans;
so is every text when nothing was learned; a word in a script that no language
has, or of a letter outside the blocks, keeps all candidates; ties go to the
language first by name; every row is labelled by itself, and each repeated row
counts in learning; a very long text is a piece of its own, and its words are still
labelled in one Viterbi pass; empty tables give empty results; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.llm.bytewords import LOWER, Piece, pieces

LETTERS = np.zeros(256, bool)                # of texts as `_plain` leaves them, where all beyond ASCII is letters and marks
LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True
OTHER = "other"
#: Unicode blocks by script, first and last code point.
BLOCKS = [
    ("latin", 0x0041, 0x02AF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("syriac", 0x0700, 0x074F), ("arabic", 0x0750, 0x077F),
    ("thaana", 0x0780, 0x07BF), ("nko", 0x07C0, 0x07FF), ("arabic", 0x0870, 0x08FF), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF),
    ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F),
    ("cherokee", 0x13A0, 0x13FF), ("canadian", 0x1400, 0x167F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF),
    ("cyrillic", 0x1C80, 0x1C8F), ("georgian", 0x1C90, 0x1CBF), ("latin", 0x1D00, 0x1DBF), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF), ("latin", 0x2C60, 0x2C7F), ("georgian", 0x2D00, 0x2D2F), ("tifinagh", 0x2D30, 0x2D7F),
    ("ethiopic", 0x2D80, 0x2DDF), ("cyrillic", 0x2DE0, 0x2DFF), ("han", 0x2E80, 0x2FDF), ("han", 0x3005, 0x3007),
    ("kana", 0x3040, 0x30FF), ("hangul", 0x3130, 0x318F), ("kana", 0x31F0, 0x31FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("yi", 0xA000, 0xA4CF), ("cyrillic", 0xA640, 0xA69F), ("latin", 0xA720, 0xA7FF),
    ("hangul", 0xA960, 0xA97F), ("latin", 0xAB30, 0xAB6F), ("cherokee", 0xAB70, 0xABBF), ("hangul", 0xAC00, 0xD7FF),
    ("han", 0xF900, 0xFAFF), ("latin", 0xFB00, 0xFB06), ("armenian", 0xFB13, 0xFB17), ("hebrew", 0xFB1D, 0xFB4F),
    ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFE), ("latin", 0xFF21, 0xFF5A), ("kana", 0xFF66, 0xFF9F),
    ("hangul", 0xFFA0, 0xFFDC), ("han", 0x20000, 0x3FFFF),
]
SCRIPTS = [*dict.fromkeys(name for name, _, _ in BLOCKS), OTHER]
_FIRST = np.array([first for _, first, _ in BLOCKS])
_LAST = np.array([last for _, _, last in BLOCKS])
_SCRIPT = np.array([SCRIPTS.index(name) for name, _, _ in BLOCKS])
HELD = 64                                    # languages whose counts a task holds
WORK = 4 << 20                               # bytes of text at a time, for four languages


def _cells(p: Piece, bits: int) -> np.ndarray:
    """Cell of the trigram around every byte; what is no letter is one symbol."""
    b = np.where(LETTERS[p.buf], p.buf, 0).astype(np.uint32)
    before, after = np.zeros_like(b), np.zeros_like(b)
    before[1:], after[:-1] = b[:-1], b[1:]
    starts = p.at[:-1][p.at[:-1] < len(b)]
    before[starts] = 0
    after[(p.at[1:] - 1)[p.at[1:] > p.at[:-1]]] = 0
    h = (before * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)).astype(np.int32)


def _plain(text: Column) -> Column:
    """Spaces for what is beyond ASCII and neither a letter nor a mark, one for each
    code point."""
    return F.regexp_replace(text, r"[^\x00-\x7F\p{L}\p{M}]", " ")


def script_of(code: np.ndarray) -> np.ndarray:
    """Number in SCRIPTS of each code point."""
    at = np.searchsorted(_FIRST, code, "right") - 1
    return np.where((at >= 0) & (code <= _LAST[at]), _SCRIPT[at], SCRIPTS.index(OTHER))


def _scripts(p: Piece) -> np.ndarray:
    """Script of every word, by its first code point."""
    if not len(p.starts):
        return np.zeros(0, np.int64)
    b = [p.buf[np.minimum(p.starts + i, len(p.buf) - 1)].astype(np.int64) for i in range(4)]
    tail = [x & 0x3F for x in b]
    two, three = (b[0] & 0x1F) << 6 | tail[1], (b[0] & 0x0F) << 12 | tail[1] << 6 | tail[2]
    four = (b[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]
    return script_of(np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0], [b[0], two, three], four))


@dataclass
class Model:
    languages: list[str]
    bits: int
    logp: np.ndarray                          # cells x languages
    written: np.ndarray                       # scripts x languages: 0 or a large loss
    penalty: float

    def words(self, p: Piece) -> np.ndarray:
        """Score of every word in every language."""
        if not len(p.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        inside = np.flatnonzero(LETTERS[p.buf])
        at = np.concatenate([[0], np.cumsum(p.ends - p.starts)[:-1]])
        return np.add.reduceat(self.logp[_cells(p, self.bits)[inside]], at, axis=0) + self.written[_scripts(p)]

    def viterbi(self, score: np.ndarray, word_at: np.ndarray) -> np.ndarray:
        """Language number of every word; the texts of a piece go step by step together."""
        n = np.diff(word_at)
        order = np.argsort(-n, kind="stable")
        first, n = word_at[:-1][order], n[order]
        label = np.zeros(len(score), np.int16)
        if not len(score):
            return label
        best = np.zeros(len(score), np.int16)
        stay = np.ones(score.shape, bool)
        live = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")       # texts with more than t words
        v = score[first[:live[0]]].copy()
        ends = np.zeros(len(n), np.int16)
        for t in range(1, int(n[0])):
            k = live[t]
            if k < len(v):
                ends[k:len(v)] = v[k:].argmax(1)
                v = v[:k]
            at = first[:k] + t
            top = v.argmax(1)
            jump = v[np.arange(k), top] - self.penalty
            keep = v >= jump[:, None]
            best[at], stay[at] = top, keep
            v = np.where(keep, v, jump[:, None]) + score[at]
        ends[:len(v)] = v.argmax(1)
        now = ends.copy()
        for t in range(int(n[0]) - 1, -1, -1):
            k = live[t]
            at = first[:k] + t
            label[at] = now[:k]
            if t:
                now[:k] = np.where(stay[at, now[:k]], now[:k], best[at])
        return label


def learn(df: DataFrame, text: str = "text", lang: str = "lang", bits: int = 15, penalty: float = 12.0, smoothing: float = 0.5,
          least_share: float = 0.01) -> Model:
    """From all rows of `df` with a known language."""
    known = df.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), _plain(F.col(text).cast("string")).alias("text"))
    cells = 1 << bits

    def rows_of(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, count in held.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(count[at])],
                                             names=["lang", "cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            names, code = np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for p in pieces(b.column(1), LETTERS, LOWER):
                own = code[p.first:p.first + p.n]
                of_byte = np.repeat(own, np.diff(p.at))
                inside = LETTERS[p.buf]
                cell, of_byte, of_word, script = _cells(p, bits)[inside], of_byte[inside], own[p.doc], _scripts(p)
                for k in np.unique(own).tolist():
                    name = str(names[k])
                    if name not in held and len(held) >= HELD:
                        yield from rows_of(held)
                        held.clear()
                    count = held.setdefault(name, np.zeros(cells + len(SCRIPTS), np.int64))
                    count[:cells] += np.bincount(cell[of_byte == k], minlength=cells)
                    count[cells:] += np.bincount(script[of_word == k], minlength=len(SCRIPTS))
        yield from rows_of(held)

    rows = known.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    count = np.zeros((cells + len(SCRIPTS), len(languages)))
    count[rows["cell"], np.searchsorted(languages, rows["lang"]) if len(rows) else []] = rows["n"]
    tri, scripts = count[:cells] + smoothing, count[cells:]
    share = scripts / np.maximum(scripts.sum(0), 1)
    written = share >= least_share
    written[~written.any(1)] = True
    written[SCRIPTS.index(OTHER)] = True
    return Model(languages, bits, np.log(tri / tri.sum(0)).astype(np.float32),
                 np.where(written, 0, -1e4).astype(np.float32), penalty)


_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def label(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score (the language's share of the letters) and spans
    (language, start, end in code points), one row per input row."""
    src = df.select(F.col(doc_id).alias("doc_id"), _plain(F.col(text).cast("string")).alias("text")) \
        .withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    held = df.sparkSession.sparkContext.broadcast(model)
    languages, n_lang = np.array([*model.languages, "und"]), len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            letter = b.column(2).to_numpy(zero_copy_only=False)
            pred, score, found = np.full(b.num_rows, n_lang), np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            for p in pieces(b.column(1), LETTERS, LOWER, max(1 << 16, WORK * 4 // max(4, n_lang))) if n_lang else ():
                own = m.viterbi(m.words(p), p.word_at)
                size = (p.ends - p.starts).astype(float)
                share = np.bincount(p.doc * n_lang + own, size, p.n * n_lang).reshape(p.n, n_lang)
                rows = slice(p.first, p.first + p.n)
                pred[rows] = np.where(letter[rows], share.argmax(1), n_lang)
                score[rows] = np.where(letter[rows], share.max(1) / np.maximum(share.sum(1), 1), 0.0)
                if spans and len(own):
                    chars = np.concatenate([[0], np.cumsum((p.buf & 0xC0) != 0x80)])
                    doc = p.doc
                    new = np.ones(len(own), bool)
                    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(own)) - 1
                    a = chars[p.starts[first]] - chars[p.at[doc[first]]]
                    z = chars[p.ends[last]] - chars[p.at[doc[first]]]
                    for d, k, x, y in zip(doc[first].tolist(), own[first].tolist(), a.tolist(), z.tolist(), strict=True):
                        if letter[p.first + d]:
                            found[p.first + d].append({"lang": m.languages[k], "start": x, "end": y})
            cols = [b.column(0), pa.array(languages[pred]), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(found, _SPANS)] * spans,
                                             names=["doc_id", "lang_pred", "score"] + ["spans"] * spans)

    fields = [T.StructField("doc_id", src.schema[0].dataType), T.StructField("lang_pred", T.StringType()),
              T.StructField("score", T.DoubleType())]
    if spans:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))
    return src.mapInArrow(run, T.StructType(fields))
