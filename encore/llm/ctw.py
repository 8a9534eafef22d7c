"""Language-model scores by context-tree weighting.

A text is its bytes (A-Z lowered) and an end sign. A byte is eight binary
decisions, each predicted from the bytes before it: a tree of contexts, the
nearest byte first, to depth four. Context bytes are folded to 64 classes, so
the tree has at most 64 + 64^2 + 64^3 + 64^4 nodes below its root.
Every node keeps Krichevsky-Trofimov counts of each decision. From the leaves
up, a node's weighted probability is half its own estimate and half the product
of its children's; from that follows how far each node trusts itself against
its children, and so a mixture over all depths for each decision. A path ends at
the last context that was seen, however rarely. The decisions of a context add
up to one row of 256 log probabilities, and scoring a byte is one look-up.

Counting covers all training texts: bytes in context and words are counted by
task, summed by shuffle, and the tree is weighted by subtrees (one per two
nearest classes, of at most 64^2 contexts). Contexts that a share 1 / KEEP of all
bytes or more was in are hot: their rows are broadcast, 1 KB each, at most KEEP
for each depth, with the classes by which a path goes on to other contexts. Of
bytes in those, the values of codes (contexts of depth four and byte) with a
share of 1 / PAIRS or more are broadcast as well, 12 bytes each; all others leave
the text's task as (text, code, times), meet their values by shuffle, and are added.

The unigram score beside it takes words: those with at least a millionth of all
tokens (so a million at most) are broadcast with their counts; the others are
joined by shuffle.

Cases: a null text is empty and has one token, the end; without training texts
every decision is even and every count 0; rows are numbered, so repeated rows
and ids stay apart and ties do not arise; a very long text is a piece of its own;
empty tables give empty results; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.bytewords import LOWER, NOT_SPACE, Piece, pieces
from encore.llm.common import cut

END = 0xFF                                   # no byte of UTF-8
START_CLASS = 63
HOT_SHARE = 1_000_000                        # at most so many words are broadcast
KEEP = 1 << 17                               # and so many contexts of a depth
PAIRS = 1 << 22                              # and so many codes in other contexts
FLUSH = 1 << 20                              # distinct keys a task holds

#: Classes of context bytes: letters, space, line ends, digits, marks, and bytes beyond ASCII by their low bits.
FOLD = np.zeros(256, np.uint32)
FOLD[0x61:0x7B] = np.arange(1, 27)
FOLD[0x41:0x5B] = np.arange(1, 27)
FOLD[0x30:0x3A] = 27
FOLD[[0x20, 0x0A, 0x0D, 0x09]] = [28, 29, 29, 30]
FOLD[[ord(c) for c in ".,;:!?'\"-()"]] = [31, 32, 33, 33, 34, 34, 35, 35, 36, 37, 37]
FOLD[0x80:0xC0] = 38 + (np.arange(0x80, 0xC0) & 15)
FOLD[0xC0:0x100] = 54 + (np.arange(0xC0, 0x100) & 7)

_HALF_LOG_TAU = 0.5 * math.log(2 * math.pi)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series above 8, the recurrence below."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] += np.log(x[low])
        x[low] += 1
    i = 1 / x
    return (x - 0.5) * np.log(x) - x + _HALF_LOG_TAU + i / 12 - i ** 3 / 360 + i ** 5 / 1260 - i ** 7 / 1680 - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def coded(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end sign: four context classes and the byte, in 32
    bits; and where each text begins."""
    buf = np.insert(p.buf, p.at[1:], END)
    at = p.at + np.arange(p.n + 1)
    c = FOLD[buf]
    starts = at[:-1]
    code = np.zeros(len(buf), np.uint32)
    for shift in (26, 20, 14, 8):
        c = np.concatenate([[np.uint32(START_CLASS)], c[:-1]]).astype(np.uint32)
        c[starts] = START_CLASS
        code |= c << np.uint32(shift)
    return code | buf, starts


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(keys) else times


class _Tally:
    """Counts of keys, handed on when they are many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n))
        self.size += len(k)
        if self.size < 4 * FLUSH:
            return None
        k, n = self.take()
        if len(k) >= FLUSH:
            return k, n
        self.parts, self.size = [(k, n)], len(k)
        return None

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        return _counted(keys, times)


GRAM, WORD, TEXTS = 0, 1, 2


def counts(train: DataFrame, text: str = "text") -> DataFrame:
    """(kind, key, n): bytes in context, words by hash, and the number of texts."""
    src = train.select(F.col(text).cast("string").alias("text"))

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.astype(np.uint64).view(np.int64)),
                                           pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies, texts = {GRAM: _Tally(), WORD: _Tally()}, 0
        for b in batches:
            texts += b.num_rows
            for p in pieces(b.column(0), NOT_SPACE, LOWER):
                for kind, keys in ((GRAM, coded(p)[0]), (WORD, p.hashes())):
                    if full := tallies[kind].add(keys):
                        yield rows(kind, *full)
        for kind, t in tallies.items():
            if t.parts:
                yield rows(kind, *t.take())
        if texts:
            yield rows(TEXTS, np.zeros(1, np.uint64), np.array([texts]))

    return src.mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


# ---- weighting -------------------------------------------------------------

def _tree(byte_counts: np.ndarray) -> np.ndarray:
    """Counts of the 255 decisions' branches: entry j is what reaches node j."""
    t = np.zeros((len(byte_counts), 512))
    t[:, 256:] = byte_counts
    for j in range(255, 0, -1):
        t[:, j] = t[:, 2 * j] + t[:, 2 * j + 1]
    return t


def _branches(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    j = np.arange(1, 256)
    return t[:, 2 * j], t[:, 2 * j + 1]


class Level:
    """Contexts of one depth, sorted, with the counts of their decisions; from
    the depth below: each decision's sum of log probabilities over children."""

    def __init__(self, contexts: np.ndarray, byte_counts: np.ndarray, below: np.ndarray | None):
        self.contexts, self.tree = contexts, _tree(byte_counts)
        zeros, ones = _branches(self.tree)
        self.seen = zeros + ones > 0
        self.kt = (ones + 0.5) / (zeros + ones + 1)
        own = _log_kt(zeros, ones)
        if below is None:
            self.log_pw, self.trust = own, np.ones_like(own)
        else:
            self.log_pw = np.logaddexp(own, below) - math.log(2)
            self.trust = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by sorted keys."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values, first, axis=0)


def subtree(codes: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels of depth 2, 3, 4 for codes that share their two nearest classes."""
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    ctx, which = np.unique(codes >> 8, return_inverse=True)
    leaf = np.zeros((len(ctx), 256))
    np.add.at(leaf, (which, codes & 255), n)
    out = [Level(ctx, leaf, None)]
    for _ in range(2):
        out.insert(0, parents(out[0].contexts, out[0].tree[:, 256:], out[0].log_pw))
    return out


def parents(contexts: np.ndarray, byte_counts: np.ndarray, log_pw: np.ndarray) -> Level:
    """The level above sorted contexts."""
    own, byte_counts = _grouped(contexts >> 6, byte_counts)
    return Level(own, byte_counts, _grouped(contexts >> 6, log_pw)[1])


def _rows(ones: np.ndarray) -> np.ndarray:
    """log10 probability of each byte from the probabilities of its decisions."""
    lp = np.zeros((len(ones), 512))
    for j in range(1, 256):
        lp[:, 2 * j] = lp[:, j] + np.log10(1 - ones[:, j - 1])
        lp[:, 2 * j + 1] = lp[:, j] + np.log10(ones[:, j - 1])
    return lp[:, 256:].astype(np.float32)


def _path_rows(levels: list[Level], depth: int, at: np.ndarray) -> np.ndarray:
    """Log10 probabilities of a byte whose path ends at contexts `at` of a depth."""
    level = levels[depth]
    own, q, seen = level.contexts[at], level.kt[at], level.seen[at]
    for up in range(depth - 1, -1, -1):
        parent = levels[up]
        at = np.searchsorted(parent.contexts, own >> (6 * (depth - up)))
        q = np.where(seen, parent.trust[at] * parent.kt[at] + (1 - parent.trust[at]) * q, parent.kt[at])
        seen = parent.seen[at]
    return _rows(q)


def _classes_below(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Bit c: context `own` has a context of class c below it that was seen."""
    out = np.zeros(len(own), np.uint64)
    at = np.searchsorted(own, below >> 6)
    ok = np.append(own, -1)[at] == below >> 6
    np.bitwise_or.at(out, at[ok], np.uint64(1) << (below[ok] & 63).astype(np.uint64))
    return out.view(np.int64)


def predictions(levels: list[Level], least: float, below: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """depth, ctx, open (classes seen below) and row of the hot contexts; keys is
    empty. levels[d] is depth d; `below` are the contexts below the last level."""
    for depth, level in enumerate(levels):
        at = np.flatnonzero(level.tree[:, 1] >= least)
        own = level.contexts[at]
        deeper = levels[depth + 1].contexts if depth + 1 < len(levels) else below
        yield pd.DataFrame({"depth": depth, "ctx": own, "open": 0 if deeper is None else _classes_below(own, deeper),
                            "row": [r.tobytes() for r in _path_rows(levels, depth, at)], "keys": b""})


def values(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """log10 probability of each code, at the last context of its path that was seen."""
    out, todo = np.zeros(len(keys), np.float32), np.ones(len(keys), bool)
    for depth in range(len(levels) - 1, -1, -1):
        contexts, own = levels[depth].contexts, keys >> (32 - 6 * depth)
        at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
        mine = todo & (contexts[at] == own)
        if mine.any():
            used, which = np.unique(at[mine], return_inverse=True)
            out[mine] = _path_rows(levels, depth, used)[which, keys[mine] & 255]
        todo &= ~mine
    return out


class Model:
    """`table`: log10 probability of each byte in each hot context. near[c] is
    the row of the nearest three classes c, far[r, c] that of a fourth class c
    for row r of a context of three; row 0 is the root. `open` and `shift`: the
    classes by which a path goes on below a row, and where a code has that class;
    `keys` and `value`: the commonest codes there. `top`: levels 0 and 1."""

    def __init__(self, near: np.ndarray, far: np.ndarray, table: np.ndarray, open_: np.ndarray | None = None,
                 depth: np.ndarray | None = None, keys: np.ndarray | None = None, value: np.ndarray | None = None,
                 top: list[Level] | None = None):
        self.near, self.far, self.table, self.top = near, far, table, top
        self.open = np.zeros(len(table), np.uint64) if open_ is None else open_
        self.more = self.open != 0
        self.shift = np.array([26, 20, 14, 8, 8], np.uint32)[np.zeros(len(table), int) if depth is None else depth]
        self.keys = np.zeros(0, np.uint32) if keys is None else keys
        self.value = np.zeros(0, np.float32) if value is None else value

    def score(self, p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text of a piece, its end included, without
        the codes that no broadcast row covers; of those text number, code and times."""
        code, starts = coded(p)
        row = self.near[code >> np.uint32(14)]
        row = self.far[row, (code >> np.uint32(8)) & np.uint32(63)]
        value = self.table[row, code & np.uint32(255)]
        at = np.flatnonzero(self.more[row])
        on = (code[at] >> self.shift[row[at]]) & np.uint32(63)
        at = at[(self.open[row[at]] >> on.astype(np.uint64)) & np.uint64(1) > 0]
        if len(self.keys):
            found = np.minimum(np.searchsorted(self.keys, code[at]), len(self.keys) - 1)
            hit = self.keys[found] == code[at]
            value[at[hit]] = self.value[found[hit]]
            at = at[~hit]
        value[at] = 0
        doc = np.searchsorted(starts, at, "right") - 1
        left, times = np.unique(doc.astype(np.uint64) << np.uint64(32) | code[at], return_counts=True)
        return (np.add.reduceat(value, starts, dtype=float), (left >> np.uint64(32)).astype(np.int64),
                (left & np.uint64(0xFFFFFFFF)).astype(np.int64), times)


def weigh(grams: DataFrame, keep: int | None = None) -> Model:
    """The model from (key, n) of bytes in context."""
    grams = grams.withColumn("two", F.shiftright("key", 20))

    def tops(pdf: pd.DataFrame) -> pd.DataFrame:
        top = subtree(pdf["key"].to_numpy(), pdf["n"].to_numpy())[0]
        return pd.DataFrame({"two": top.contexts, "pw": [top.log_pw[0].tolist()], "bytes": [top.tree[0, 256:].tolist()]})

    top = grams.groupBy("two").applyInPandas(tops, "two long, pw array<double>, bytes array<double>").toPandas().sort_values("two")
    if not len(top):
        return Model(np.zeros(1 << 18, np.int32), np.zeros((1, 64), np.int32), np.full((1, 256), math.log10(1 / 256), np.float32))
    two = top["two"].to_numpy()
    one = parents(two, np.array(top["bytes"].tolist()), np.array(top["pw"].tolist()))
    root = parents(one.contexts, one.tree[:, 256:], one.log_pw)
    least, common = root.tree[0, 1] / (keep or KEEP), root.tree[0, 1] / PAIRS

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n = pdf["key"].to_numpy(), pdf["n"].to_numpy()
        levels = [root, one, *subtree(key, n)]
        cold = levels[4].tree[np.searchsorted(levels[4].contexts, key >> 8), 1] < least
        key = np.sort(key[cold & (n >= common)])
        pairs = pd.DataFrame({"depth": -1, "ctx": key[:1], "open": 0, "row": [values(levels, key).tobytes()][:len(key)],
                              "keys": [key.astype(np.uint32).tobytes()][:len(key)]})
        return pd.concat([pairs, *list(predictions(levels, least))[2:]])

    found = grams.groupBy("two").applyInPandas(tables, "depth int, ctx long, open long, row binary, keys binary").toPandas()
    # by two nearest classes, so in the order of their codes
    pairs, found = found[found["depth"] < 0].sort_values("ctx"), found[found["depth"] >= 0]
    found = pd.concat([*predictions([root, one], 0, two), found]).sort_values(["depth", "ctx"], ignore_index=True)
    depth, ctx = found["depth"].to_numpy().astype(int), found["ctx"].to_numpy().astype(np.int64)
    near = np.zeros(1 << 18, np.int32)
    for d in (1, 2, 3):                      # deeper contexts take the place of shallower ones
        own = np.zeros(1 << (6 * d), np.int32)
        own[ctx[depth == d]] = np.flatnonzero(depth == d)
        wide = np.repeat(own, 1 << (6 * (3 - d)))
        near = np.where(wide > 0, wide, near)
    far = np.repeat(np.arange((depth < 4).sum(), dtype=np.int32)[:, None], 64, axis=1)
    four = np.flatnonzero(depth == 4)
    far[near[ctx[four] >> 6], ctx[four] & 63] = four
    # what a kept row covers by itself is not open
    open_ = found["open"].to_numpy().astype(np.int64).view(np.uint64).copy()
    deep = np.flatnonzero(depth > 0)
    up = np.searchsorted(depth * (1 << 24) + ctx, (depth[deep] - 1) * (1 << 24) + (ctx[deep] >> 6))
    np.bitwise_and.at(open_, up, ~(np.uint64(1) << (ctx[deep] & 63).astype(np.uint64)))
    return Model(near, far, np.frombuffer(b"".join(found["row"]), np.float32).reshape(-1, 256), open_, depth,
                 np.frombuffer(b"".join(pairs["keys"]), np.uint32), np.frombuffer(b"".join(pairs["row"]), np.float32), [root, one])


def looked_up(grams: DataFrame, keys: DataFrame, top: list[Level] | None) -> DataFrame:
    """(key, value) of distinct codes, from all contexts that were seen."""
    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        key = asked["key"].to_numpy()
        if not len(key) or not len(own):
            return pd.DataFrame({"key": key[:0], "value": np.zeros(0)})
        return pd.DataFrame({"key": key, "value": values([*top, *subtree(own["key"].to_numpy(), own["n"].to_numpy())], key)})

    two = F.shiftright("key", 20).alias("two")
    return grams.groupBy(two).cogroup(keys.groupBy(two)).applyInPandas(run, "key long, value double")


# ---- scores ----------------------------------------------------------------

def score(df: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, train (whether the row was learned from), n_bytes, n_tokens,
    n_known, train_tokens, base_score and score; one row per input row."""
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), train.alias("train"))
    tallied = cut(counts(src.filter("train")))
    words = tallied.filter(F.col("kind") == WORD).select(F.col("key").alias("h"), "n")
    total = tallied.filter(F.col("kind") != GRAM).agg(F.sum("n"), F.sum(F.when(F.col("kind") == WORD, 1).otherwise(0)),
                                                     F.sum(F.when(F.col("kind") == TEXTS, F.col("n")).otherwise(0))).first()
    tokens, distinct, texts = (int(x or 0) for x in total)
    denominator = tokens + 0.5 * (distinct + (texts > 0) + 1)
    least = max(1, -(-tokens // HOT_SHARE))
    hot = words.filter(F.col("n") >= least).toPandas().sort_values("h")
    # sorted as unsigned numbers, like the hashes they are looked up by
    key = hot["h"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    sc = df.sparkSession.sparkContext
    grams = tallied.filter(F.col("kind") == GRAM).select("key", "n")
    weighed = weigh(grams)
    held = sc.broadcast((weighed, key[order],
                         np.log10((hot["n"].to_numpy()[order] + 0.5) / denominator)))
    end = math.log10((texts + 0.5) / denominator)
    numbered = src.withColumn("rid", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, value = held.value
        for b in batches:
            for p in pieces(b.column(1), NOT_SPACE, LOWER):
                h, doc = p.hashes(), p.doc
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                is_hot = known[at] == h if len(known) else np.zeros(len(h), bool)
                n_hot = np.bincount(doc[is_hot], minlength=p.n)
                base = np.bincount(doc[is_hot], value[at[is_hot]], p.n) + end
                rare = np.flatnonzero(~is_hot)
                edge = np.searchsorted(doc[rare], np.arange(p.n + 1)).astype(np.int32)
                scores, owner, left, times = model.score(p)
                edges = np.searchsorted(owner, np.arange(p.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(3).slice(p.first, p.n), b.column(0).slice(p.first, p.n), b.column(2).slice(p.first, p.n),
                     pa.array(np.diff(p.at)), pa.array(np.diff(p.word_at) + 1), pa.array(n_hot + (texts > 0)),
                     pa.array(base), pa.array(scores),
                     pa.ListArray.from_arrays(pa.array(edge), pa.array(h[rare].view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(edges), pa.array(times.astype(np.int64) << 32 | left))], names=NAMES)

    kind = numbered.schema["doc_id"].dataType.simpleString()
    done = cut(numbered.select("doc_id", "text", "train", "rid").mapInArrow(
        run, f"rid long, doc_id {kind}, train boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double, rare array<long>, cold array<long>"))
    # the other words: one row each, with their counts by shuffle
    rest = done.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").agg(F.count("*").alias("times")) \
        .join(words.filter(F.col("n") < least), "h", "left") \
        .groupBy("rid").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
                            F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(denominator))).alias("more_base"))
    # bytes in the other contexts: as often as a text has them, with their values by shuffle
    cold = done.select("rid", F.explode("cold").alias("x")) \
        .select("rid", F.col("x").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key"), F.shiftright("x", 32).alias("times"))
    found = cut(looked_up(grams, cold.select("key").distinct(), weighed.top))
    cold = cold.join(found, "key").groupBy("rid").agg(F.sum(F.col("times") * F.col("value")).alias("more_score"))
    return done.drop("rare", "cold").join(rest, "rid", "left").join(cold, "rid", "left").select(
        "doc_id", "train", "n_bytes", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))


NAMES = ["rid", "doc_id", "train", "n_bytes", "n_tokens", "n_known", "base_score", "score", "rare", "cold"]
