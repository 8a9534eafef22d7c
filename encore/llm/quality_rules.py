"""Quality rules: an isolation forest over rule statistics.

`rule_statistics` counts, for every whole text, the figures that quality rules
look at; the forest sees ratios of them, so that a long clean text looks like a
short clean one. What is usual is learned: for each ratio, the band between two
quantiles (`tail` and 1 - `tail`) of good labelled rows, wider by a share `slack` of
itself on each side, counts as 0, and beyond it the distance from the band, so that
splits part only rows that stand out. `fit`
takes the bands and grows a forest of random splits over a bounded sample of
labelled rows (`sample_rows`, parameter) and then calibrates its threshold on
the scores of all labelled rows. A row whose path through the trees is short
is an anomaly. `judge` rejects rows that fail the base rules or whose anomaly
score is above the threshold.

Cases: a null or empty text has no words and fails the base rules; rows are
judged one by one, so ties and repeated rows get equal verdicts; rows alike in id and
counts are one in the sample; a very long text is a piece of its own; without any
labelled row of either class there is no threshold and only the base rules
reject; empty tables give empty results. Columns of the input are kept, and
computed ones do not depend on their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.llm.bytewords import NOT_SPACE, mix, pieces, span_hashes, text_windows
from encore.llm.common import bounded_sample, cut

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_marks", "n_distinct"]
RATIOS = ["word_length", "symbols", "dup_lines", "repeats", "upper", "marks"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?~^_=+@{}[]/\\"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def _groups(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of (text, hash), which of them open a group, group sizes."""
    key = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    sizes = np.diff(np.append(np.flatnonzero(first), len(k)))
    return order, first, sizes


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts per text; see COUNTS and EXTRA."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in COUNTS + EXTRA}
    for p in pieces(texts, NOT_SPACE):
        doc = p.doc
        inside = NOT_SPACE[p.buf]
        res = {"n_words": np.diff(p.word_at),
               "word_chars": _per_text(inside & ((p.buf & 0xC0) != 0x80), p.at),
               "n_symbols": _per_text(_SYMBOL[p.buf], p.at),
               "n_upper": _per_text(_UPPER[p.buf], p.at),
               "n_marks": _per_text(_MARK[p.buf], p.at)}
        # lines: from a text's start or a newline to the next newline or the text's end
        nl = np.flatnonzero(p.buf == 10)
        starts = np.unique(np.concatenate([p.at[:-1], nl + 1]))
        starts = starts[starts < len(p.buf)]
        ends = np.append(starts[1:], len(p.buf))[:len(starts)]
        ends = ends - (p.buf[ends - 1] == 10)
        count = np.concatenate([[0], np.cumsum(inside)])
        full = count[ends] > count[starts]
        starts, ends = starts[full], ends[full]
        line_doc = np.searchsorted(p.at, starts, "right") - 1
        order, first, _ = _groups(line_doc, span_hashes(p.buf, starts, ends))
        res["n_lines"] = np.bincount(line_doc, minlength=p.n)
        res["n_dup_lines"] = np.bincount(line_doc[order][~first], minlength=p.n)
        words = p.hashes()
        order, first, _ = _groups(doc, words)
        res["n_distinct"] = np.bincount(doc[order][first], minlength=p.n)
        pos, h = text_windows(p, words, 3)
        order, first, sizes = _groups(doc[pos], h)
        again = pos[order][np.repeat(sizes >= 2, sizes)]
        hit = np.zeros(len(doc) + 3, bool)
        for i in range(3):
            hit[again + i] = True
        res["n_repeat_words"] = np.bincount(doc[hit[:len(doc)]], minlength=p.n)
        for k, v in res.items():
            out[k].append(v)
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


def ratios(s: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, RATIOS)."""
    n = np.maximum(s["n_words"], 1)
    return np.column_stack([s["word_chars"] / n, s["n_symbols"] / n, s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
                            s["n_repeat_words"] / n, s["n_upper"] / np.maximum(s["word_chars"], 1), s["n_marks"] / n])


def usual(x: np.ndarray, tail: float, slack: float) -> np.ndarray:
    """(2, RATIOS): the band of what good rows show."""
    if not len(x):
        return np.tile([[-np.inf], [np.inf]], len(RATIOS))
    low, high = np.quantile(x, [tail, 1 - tail], axis=0)
    return np.array([low - slack * (high - low), high + slack * (high - low)])


def beyond(x: np.ndarray, band: np.ndarray) -> np.ndarray:
    """How far each ratio is outside its band."""
    return np.maximum(0, np.maximum(band[0] - x, x - band[1]))


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    trees: list = field(default_factory=list)
    norm: float = 1.0
    threshold: float = float("inf")
    band: np.ndarray = field(default_factory=lambda: usual(np.zeros((0, len(RATIOS))), 0, 0))

    def anomaly(self, s: dict[str, np.ndarray]) -> np.ndarray:
        """Score of rows with these counts."""
        return self.score(beyond(ratios(s), self.band))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for anomalies."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feat, split, left, right, leaf in self.trees:
            at = np.zeros(len(x), np.int32)
            while True:
                f = feat[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] < split[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += leaf[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def grow(x: np.ndarray, n_trees: int = 100, subsample: int = 256, seed: int = 7) -> Forest:
    """Random feature, random split between the node's least and largest value."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(x))
    if size < 2:
        return Forest()
    limit = int(np.ceil(np.log2(size)))
    forest = Forest(norm=float(_average_path(np.array(size))) or 1.0)
    for _ in range(n_trees):
        feat, split, left, right, leaf = [], [], [], [], []
        todo = [(rng.choice(len(x), size, replace=False), 0, -1, False)]
        while todo:
            rows, depth, parent, is_right = todo.pop()
            me = len(feat)
            if parent >= 0:
                (right if is_right else left)[parent] = me
            part = x[rows]
            lo, hi = part.min(0), part.max(0)
            open_ = np.flatnonzero(hi > lo)
            for col, v in ((feat, -1), (split, 0.0), (left, me), (right, me),
                           (leaf, depth + float(_average_path(np.array(len(rows)))))):
                col.append(v)
            if depth >= limit or len(rows) < 2 or not len(open_):
                continue
            f = int(rng.choice(open_))
            feat[me], split[me] = f, float(rng.uniform(lo[f], hi[f]))
            go = part[:, f] < split[me]
            todo += [(rows[go], depth + 1, me, False), (rows[~go], depth + 1, me, True)]
        forest.trees.append((np.array(feat, np.int32), np.array(split), np.array(left, np.int32),
                             np.array(right, np.int32), np.array(leaf)))
    return forest


def calibrate(counts: list[tuple[int, int, int]], bins: int, max_loss: float) -> float:
    """From (label, bin, rows): the score above which most bad rows lie, while
    at most `max_loss` of the good ones do (largest bad share minus good share)."""
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for label, b, n in counts:
        (good if label else bad)[b] += n
    if not good.sum() or not bad.sum():
        return float("inf")
    above = lambda v: v[::-1].cumsum()[::-1] / v.sum()
    g, d = above(good), above(bad)
    gain = np.where(g <= max_loss, d - g, -1)
    best = int(gain.argmax())
    return best / bins if gain[best] > 0 else float("inf")


_STAT_FIELDS = [T.StructField(c, T.LongType()) for c in COUNTS + EXTRA]


def rule_statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts, one row per input row."""
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[c]) for c in COUNTS + EXTRA)],
                                             names=["doc_id", *COUNTS, *EXTRA])

    return src.mapInArrow(run, T.StructType([T.StructField("doc_id", src.schema[0].dataType), *_STAT_FIELDS]))


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in COUNTS + EXTRA}


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 25_600, n_trees: int = 100,
        subsample: int = 256, contamination: float = 0.02, max_loss: float = 0.005, bins: int = 1000, tail: float = 0.001,
        slack: float = 0.25, seed: int = 7) -> Forest:
    """Bands and trees over at most about `sample_rows` good labelled rows and a share
    `contamination` of bad ones (many alike would hide each other); threshold
    from the scores of all labelled rows, counted in `bins` steps on the executors."""
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("_good"))
    # the forest only judges what the base rules leave
    known = stats.filter("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").join(marked, "doc_id") \
        .select(*COUNTS, *EXTRA, "_good", "doc_id")

    def sample_of(rows: DataFrame, n: int):
        return bounded_sample(rows, ["doc_id", *COUNTS, *EXTRA], n, seed).toPandas().sort_values(["doc_id", *COUNTS, *EXTRA])

    sample = sample_of(known.filter("_good = 1"), sample_rows)
    odd = max(1, round(contamination * len(sample)))
    band = usual(ratios({c: sample[c].to_numpy() for c in COUNTS + EXTRA}), tail, slack)
    sample = pd.concat([sample, sample_of(known.filter("_good = 0"), odd).head(odd)], ignore_index=True)
    forest = grow(beyond(ratios({c: sample[c].to_numpy() for c in COUNTS + EXTRA}), band), n_trees, subsample, seed)
    forest.band = band
    if not forest.trees:
        return forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = (forest.anomaly(_columns(b)) * bins).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("_good")), pa.array(s)],
                                             names=["good", "bin"])

    counts = known.mapInArrow(run, "good int, bin int").groupBy("good", "bin").count().collect()
    forest.threshold = calibrate([(r[0], r[1], r[2]) for r in counts], bins, max_loss)
    return forest


def verdicts(stats: DataFrame, forest: Forest) -> DataFrame:
    """Adds base_failed, score and kept to the rows of `rule_statistics`."""
    names = [*stats.columns, "base_failed", "score", "kept"]
    schema = T.StructType([*stats.schema.fields, T.StructField("base_failed", T.BooleanType()),
                           T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _columns(b)
            failed, score = base_failed(s), forest.anomaly(s)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(score),
                                              pa.array(~failed & (score <= forest.threshold))], names=names)

    return stats.mapInArrow(run, schema)


def reject(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = statistics(b.column(where))
            yield b.filter(pa.array(~base_failed(s) & (forest.anomaly(s) <= forest.threshold)))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """One row per document: its counts, base_failed, score and kept."""
    stats = cut(rule_statistics(docs))
    return verdicts(stats, fit(stats, labels, **fitting))
