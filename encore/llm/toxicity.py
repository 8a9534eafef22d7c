"""Toxicity with a subsequence string kernel, Nystroem landmarks and a linear
support vector machine.

Two words are alike as far as they share subsequences of three letters; a gap
costs a factor per letter skipped (`decay`), within `REACH` letters. So a word
with letters put in, or one that goes on after an insult's root, stays close to
the insult. Before that, look-alike signs become letters, other signs inside a
word are dropped, and three or more single letters in a row are one word.

A text is compared with each landmark by its closest word, and by how much its
different words that are close add up to. These values, each kind mapped by the
inverse root of the landmarks' own kernel matrix, are what a squared hinge
machine separates; a logistic curve turns its margin into a score. Texts
are labelled as wholes, so a sentence that holds the word decides for its text.

Learning takes at most about `sample_rows` labelled texts, picked by a hash of
their id, at least a tenth of them of each class where there are that many; every
text is scored whole. Words of these texts are counted exactly. Landmarks come from
the words of `LENGTHS` letters that two or more toxic texts hold and that are
commoner there: the first `n_landmarks` by likelihood ratio that are not nearly one
another, among the first `n_candidates`. Words of other lengths are no landmarks but
are compared with them like any word.

Cases: a null, empty or wordless text is like no landmark and gets the score of
that; without labelled rows of both classes every text scores 0; a text labelled
twice counts as toxic if either says so; where rows repeat a labelled id, the least
of their texts is learned from; rows are scored one by one, so repeated rows score
alike; ties between landmarks go to the word first in order; a very long text is a
piece of its own; empty tables give empty results; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.llm.bytewords import NOT_SPACE, Piece, pieces, span_hashes
from encore.llm.common import bounded_sample

REACH = 4                                    # from a subsequence's first letter to its last
GAPS = [(a, b) for a in range(1, REACH) for b in range(1, REACH) if a + b <= REACH]
FLOOR, CLOSE = 0.3, 0.5
LENGTHS = (3, 40)                            # bytes of a landmark, least and most
WORK = 2 << 20                               # bytes of text at a time
CACHE = 60_000                               # words whose kernel values a task keeps

#: Lower case, and signs that stand for letters.
LETTER = np.zeros(256, np.uint8)
LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTER[0x80:] = np.arange(0x80, 0x100)
for _sign, _letter in zip("013457$@", "oieastsa", strict=True):
    LETTER[ord(_sign)] = ord(_letter)
CLASS = np.zeros(256, np.int64)              # 64 classes: letters, and bytes beyond ASCII by their low bits
CLASS[0x61:0x7B] = np.arange(1, 27)
CLASS[0x80:] = 27 + (np.arange(0x80, 0x100) & 31)


def words_of(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of a piece; starts and ends of its words in them; text of each word."""
    mapped = LETTER[p.buf]
    used = (mapped > 0)
    at = np.concatenate([[0], np.cumsum(used)])
    starts, ends, doc = at[p.starts], at[p.ends], p.doc
    some = ends > starts
    starts, ends, doc = starts[some], ends[some], doc[some]
    if len(starts):
        alone = ends - starts == 1
        run = np.cumsum(np.append(True, ~(alone[1:] & alone[:-1] & (doc[1:] == doc[:-1])))) - 1
        long_run = np.bincount(run)[run] >= 3
        first = np.append(True, run[1:] != run[:-1]) | ~long_run
        last = np.append(first[1:], True)
        starts, ends, doc = starts[first], ends[last], doc[first]
    return mapped[used], starts, ends, doc


def _norm(n: np.ndarray, decay: float) -> np.ndarray:
    return np.sqrt(sum(np.maximum(n - a - b, 0) * decay ** (2 * (a + b - 2)) for a, b in GAPS))


def _subsequences(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, decay: float):
    """(word, cell, weight) of every gapped three letters of every word."""
    n = ends - starts
    word = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(word)) + np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    c, stop = CLASS[letters], ends[word] if len(n) else starts
    for a, b in GAPS:
        ok = pos + a + b < stop
        at = pos[ok]
        yield word[ok], (c[at] << 12) | (c[at + a] << 6) | c[at + a + b], decay ** (a + b - 2)


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    decay: float = 0.7
    row: np.ndarray | None = None            # row of each cell in `table`, 0 where no landmark has it
    table: np.ndarray | None = None
    weights: np.ndarray | None = None        # of the machine, in terms of landmark values
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def _sparse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The table by rows: where each row's landmarks begin, their numbers, their values."""
        if not hasattr(self, "_rows"):
            r, c = np.nonzero(self.table)
            self._rows = (np.searchsorted(r, np.arange(len(self.table) + 1)), c, self.table[r, c].astype(float))
        return self._rows

    def kernel(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 10_000) -> np.ndarray:
        """Likeness (0 to about 1) of every word with every landmark."""
        m = self.table.shape[1]
        begin, landmark, value = self._sparse()
        out = np.zeros((len(starts), m), np.float32)
        for i in range(0, len(starts), block):
            s, e = starts[i:i + block], ends[i:i + block]
            found = [(w[k > 0], k[k > 0], np.full(int((k > 0).sum()), x))
                     for w, c, x in _subsequences(letters, s, e, self.decay) for k in [self.row[c]]]
            word, k, weight = (np.concatenate(x) for x in zip(*found, strict=True))
            # one entry for each landmark that has the subsequence
            n = begin[k + 1] - begin[k]
            entry = np.repeat(np.arange(len(k)), n)
            at = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + begin[k][entry]
            sums = np.bincount(word[entry] * m + landmark[at], value[at] * weight[entry], len(s) * m).reshape(len(s), m)
            out[i:i + block] = sums / np.maximum(_norm(e - s, self.decay), 1e-9)[:, None]
        return out

    def closest(self, texts: pa.Array, cache: dict) -> np.ndarray:
        """For every text, its closest word's likeness to each landmark beyond
        FLOOR, then log(1 + sum) of its different words' likeness beyond CLOSE."""
        out, m = [], self.table.shape[1]
        for p in pieces(texts, NOT_SPACE, size=WORK):
            letters, starts, ends, doc = words_of(p)
            best = np.zeros((p.n, 2 * m), np.float32)
            if len(starts):
                h = span_hashes(letters, starts, ends)
                distinct, example, which = np.unique(h, return_index=True, return_inverse=True)
                known, values = cache.get("h", np.zeros(0, np.uint64)), cache.get("k")
                at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
                have = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
                k = np.zeros((len(distinct), m), np.float32)
                if have.any():
                    k[have] = values[at[have]]
                new = example[~have]
                k[~have] = self.kernel(letters, starts[new], ends[new])
                if len(known) < CACHE:       # the words met first are the common ones
                    merged = np.concatenate([known, distinct[~have]])
                    order = np.argsort(merged)
                    cache["h"] = merged[order]
                    cache["k"] = np.concatenate([values, k[~have]])[order] if values is not None else k[~have]
                like = (k > FLOOR).any(1)                           # few words are like any landmark at all
                doc, which = doc[like[which]], which[like[which]]
                if len(doc):
                    doc, which = np.divmod(np.unique(doc * len(distinct) + which), len(distinct))   # each word of a text once
                    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    values = k[which]
                    best[doc[first], :m] = np.maximum(np.maximum.reduceat(values, first, axis=0) - FLOOR, 0)
                    best[doc[first], m:] = np.log1p(np.add.reduceat(np.maximum(values - CLOSE, 0), first, axis=0))
            out.append(best)
        return np.concatenate(out) if out else np.zeros((0, 2 * m), np.float32)

    def score(self, closest: np.ndarray) -> np.ndarray:
        margin = closest @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def _packed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(w) for w in raw]), ends


def _tables(words: list[str], decay: float) -> tuple[np.ndarray, np.ndarray]:
    letters, starts, ends = _packed(words)
    found = list(_subsequences(letters, starts, ends, decay))
    cells = np.unique(np.concatenate([c for _, c, _ in found]))
    row = np.zeros(1 << 18, np.int32)
    row[cells] = np.arange(1, len(cells) + 1)
    table = np.zeros((len(cells) + 1, len(words)), np.float32)
    for w, c, x in found:
        np.add.at(table, (row[c], w), x)
    return row, (table / np.maximum(_norm(ends - starts, decay), 1e-9)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared hinge, both classes with equal weight, solved by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    sign = np.where(y > 0, 1.0, -1.0)
    c = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)) * cost * len(y)
    w, keep = np.zeros(z.shape[1]), np.diag([*np.ones(x.shape[1]), 1e-6])
    for _ in range(rounds):
        on = sign * (z @ w) < 1
        new = np.linalg.solve(keep + 2 * (z[on].T * c[on]) @ z[on], 2 * z[on].T @ (c[on] * sign[on]))
        if np.allclose(new, w, atol=1e-10):
            break
        w = new
    return w[:-1], float(w[-1])


def curve(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins (Newton)."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + 1e-6 * np.eye(2), z.T @ (goal - p) - 1e-6 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _likelihood_ratio(a: Column, b: Column, na: int, nb: int) -> Column:
    """Log-likelihood ratio of a word that `a` of `na` toxic and `b` of `nb` other texts hold."""
    def part(k: Column, n: int, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (n - k) * F.log(1 - p)

    both = (a + b) / (na + nb)
    return F.round(part(a, na, a / na) + part(b, nb, b / nb) - part(a, na, both) - part(b, nb, both), 9)


def _word_counts(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column(0).to_numpy(zero_copy_only=False)
            for p in pieces(b.column(1), NOT_SPACE):
                letters, starts, ends, doc = words_of(p)
                raw = letters.tobytes()
                pairs = {(d, raw[s:e]) for d, s, e in zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True)
                         if LENGTHS[0] <= e - s <= LENGTHS[1]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w.decode("utf-8", "ignore") for _, w in pairs], pa.string()),
                     pa.array([int(toxic[p.first + d]) for d, _ in pairs], pa.int64())], names=["word", "toxic"])

    return sample.select("toxic", "text").mapInArrow(run, "word string, toxic long") \
        .groupBy("word").agg(F.sum("toxic").alias("a"), (F.count("*") - F.sum("toxic")).alias("b"))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, n_landmarks: int = 96, n_common: int = 16,
          n_candidates: int = 576, decay: float = 0.7, cost: float = 0.1, seed: int = 8, text: str = "text", doc_id: str = "doc_id") -> Model:
    """From the rows of `docs` that `labels` (doc_id, toxic) marks."""
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = bounded_sample(marked, ["doc_id"], sample_rows, seed, by="toxic")
    # at most 2 * sample_rows ids: a broadcast of known size
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    size = sample.agg(F.sum("toxic"), F.count("*")).first()
    n1, n0 = int(size[0] or 0), int(size[1] - (size[0] or 0))
    if not n1 or not n0:
        return Model()
    counts = _word_counts(sample)
    # candidates: words of at least two toxic texts, and the commonest words
    part = counts.filter(f"a >= 2 and a * {n0} > b * {n1}") \
        .withColumn("r", _likelihood_ratio(F.col("a"), F.col("b"), n1, n0)).orderBy(F.desc("r"), "word").limit(n_candidates).toPandas()
    common = counts.orderBy(F.desc("b"), "word").limit(n_common).toPandas()
    words = [w for w in part["word"] if len(w) >= 3] + [w for w in common["word"] if len(w) >= 3]
    if not words:
        return Model()
    # of words that are nearly one another, the first
    row, table = _tables(words, decay)
    like = Model(words, decay, row, table).kernel(*_packed(words))
    chosen: list[int] = []
    for i, w in enumerate(words):
        room = len(chosen) < n_landmarks or i >= len(part)
        if room and like[i, i] > 0 and (not chosen or like[i, chosen].max() < 0.95):
            chosen.append(i)
    words = [words[i] for i in chosen]
    if not words:
        return Model()
    row, table = _tables(words, decay)
    model = Model(words, decay, row, table)
    like = model.kernel(*_packed(words)).astype(float)
    values, vectors = np.linalg.eigh((like + like.T) / 2)
    root = (vectors / np.sqrt(np.maximum(values, 1e-3 * values.max()))) @ vectors.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            x = model.closest(b.column(2), cache)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.tolist(), pa.list_(pa.float32()))],
                                             names=["doc_id", "toxic", "x"])

    schema = T.StructType([T.StructField("doc_id", sample.schema[0].dataType), T.StructField("toxic", T.IntegerType()),
                           T.StructField("x", T.ArrayType(T.FloatType()))])
    rows: pd.DataFrame = sample.mapInArrow(run, schema).toPandas()
    x, y = np.array(rows["x"].tolist()), rows["toxic"].to_numpy()
    order = np.lexsort((*x.T[:3], y, rows["doc_id"].to_numpy()))
    root = np.kron(np.eye(2), root)
    x, y = x[order] @ root, y[order]
    w, model.bias = machine(x, y, cost)
    model.slope, model.shift = curve(x @ w + model.bias, y)
    model.weights = root @ w
    return model


def score(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score and predicted, one row per input row."""
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = held.value, {}
        for b in batches:
            s = m.score(m.closest(b.column(1), cache)) if m.landmarks else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return src.mapInArrow(run, T.StructType([T.StructField("doc_id", src.schema[0].dataType),
                                             T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
