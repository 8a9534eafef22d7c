import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from encore.llm import ctw as C
from encore.llm import queries
from encore.llm.bytewords import LOWER, NOT_SPACE, pieces
from tests.llm.helpers import ODD_TEXTS, documents, random_texts


def sequence(text):
    b = bytes(LOWER[c] for c in (text or "").encode()) + b"\xff"
    past = [C.START_CLASS] * 4 + [int(C.FOLD[c]) for c in b]
    return [(c, tuple(past[i + 3 - d] for d in range(4))) for i, c in enumerate(b)]


class Brute:
    """Context-tree weighting as it is defined, one decision at a time."""

    def __init__(self, texts):
        self.n, self.children = defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            for c, ctx in sequence(t):
                for j, bit in self.decisions(c):
                    for d in range(5):
                        self.n[ctx[:d], j][bit] += 1
                        if d:
                            self.children[ctx[:d - 1], j].add(ctx[:d])
        self.memo = {}

    @staticmethod
    def decisions(c):
        return [((1 << k) | (c >> (8 - k)), (c >> (7 - k)) & 1) for k in range(8)]

    def kt(self, ctx, j):
        a, b = self.n[ctx, j]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, ctx, j):
        return sum(self.pw(x, j) for x in self.children[ctx, j])

    def pw(self, ctx, j):
        if (ctx, j) not in self.memo:
            own = self.kt(ctx, j)
            self.memo[ctx, j] = own if len(ctx) == 4 else np.logaddexp(own, self.below(ctx, j)) - math.log(2)
        return self.memo[ctx, j]

    def one(self, ctx, j, d=0):
        a, b = self.n[ctx[:d], j]
        own = (b + .5) / (a + b + 1)
        if d == 4 or ctx[:d + 1] not in self.children[ctx[:d], j]:
            return own
        w = 1 / (1 + math.exp(min(700, self.below(ctx[:d], j) - self.kt(ctx[:d], j))))
        return w * own + (1 - w) * self.one(ctx, j, d + 1)

    def score(self, text):
        total = 0.0
        for c, ctx in sequence(text):
            for j, bit in self.decisions(c):
                p = self.one(ctx, j)
                total += math.log10(p if bit else 1 - p)
        return total


def is_train(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def test_matches_brute_force(spark):
    texts = ODD_TEXTS[:9] + random_texts(60, words=12) + ["an ant and a hand", "the band stands", "zzz qqq"]
    docs = documents(spark, texts).selectExpr("*", "1 as score", "2 as rid", "3 as train").repartition(4)
    got = {r.doc_id: r for r in C.score(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1).collect()}
    train = [t for i, t in enumerate(texts) if is_train(i)]
    model = Brute(train)
    count = Counter(w for t in train for w in words(t))
    n = sum(count.values()) + len(train)
    log = lambda c: math.log10((c + .5) / (n + .5 * (len(count) + 2)))
    assert 0 < sum(r.train for r in got.values()) < len(texts)
    for i, t in enumerate(texts):
        w, r = words(t), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(count[x] > 0 for x in w) + 1, n)
        assert r.base_score == pytest.approx(sum(log(count[x]) for x in w) + log(len(train)), rel=1e-9)
        assert r.score == pytest.approx(model.score(t), rel=1e-4), t


def test_rows_are_distributions_and_pruning_bounds_them(spark):
    grams = C.counts(documents(spark, random_texts(200))).filter("kind = 0")
    for keep in (None, 30):
        m = C.weigh(grams, keep)
        np.testing.assert_allclose((10.0 ** m.table.astype(float)).sum(1), 1, rtol=1e-3)
        assert m.near.max() < len(m.far) and m.far.max() < len(m.table)
    assert len(m.table) < 1 + 64 + 3 * 30


def test_log_gamma():
    x = np.concatenate([np.arange(0.5, 30, 0.5), [1e3, 1e6 + .5, 1e9]])
    np.testing.assert_allclose(C.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_rare_words_by_shuffle_agree(spark, monkeypatch):
    docs = documents(spark, random_texts(300) + ["seen once", "never %d" % 5])
    key = ["doc_id", "n_tokens", "n_known", "base_score"]
    want = C.score(docs, F.col("doc_id") % 5 != 1).select(*key).orderBy("doc_id").collect()
    monkeypatch.setattr(C, "HOT_SHARE", 20)
    monkeypatch.setattr(C, "FLUSH", 16)
    got = C.score(docs, F.col("doc_id") % 5 != 1).select(*key).orderBy("doc_id").collect()
    for a, b in zip(want, got, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])


@pytest.mark.parametrize("keep,pairs", [(30, 1 << 22), (30, 500), (300, 1), (2, 1)])
def test_rare_contexts_count_in_scores(spark, monkeypatch, keep, pairs):
    docs = documents(spark, ODD_TEXTS + random_texts(120) + ["an ant and a hand", "zzz qqq", "the w1 band"])
    want = {r.doc_id: r.score for r in C.score(docs, F.col("doc_id") % 5 != 1).collect()}
    monkeypatch.setattr(C, "KEEP", keep)
    monkeypatch.setattr(C, "PAIRS", pairs)
    got = {r.doc_id: r.score for r in C.score(docs, F.col("doc_id") % 5 != 1).collect()}
    assert got == pytest.approx(want, rel=1e-5) and len(got) == docs.count()


def test_pieces_code_texts_apart():
    texts = pa.array(ODD_TEXTS + ["ab", "", "c"], pa.string())
    for p in pieces(texts, NOT_SPACE, LOWER):
        code, starts = C.coded(p)
        want = [(x[0] << 26 | x[1] << 20 | x[2] << 14 | x[3] << 8 | c) for t in texts for c, x in sequence(t.as_py())]
        assert code.tolist() == want and len(starts) == len(texts)


def test_repeats_and_empty_tables(spark):
    docs = documents(spark, ["a b", None, "a b"])
    twice = docs.union(docs).union(docs.selectExpr("cast(null as long)", *docs.columns[1:]))
    rows = C.score(twice, F.coalesce(F.col("doc_id"), F.lit(0)) != 1).collect()
    assert len(rows) == 9 and len({r.score for r in rows if r.n_tokens == 3}) == 1
    assert [r.n_tokens for r in C.score(docs, F.lit(False)).orderBy("doc_id").collect()] == [3, 1, 3]
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in C.score(docs, F.lit(False)).collect())
    assert C.score(docs.limit(0), F.lit(True)).count() == 0


def test_model_beats_a_flat_guess_on_held_out_text(spark):
    rows = queries.op7_ctw(spark, "/root/testdata/sf0.01").filter("held_out and n_bytes > 100").collect()
    bits = -sum(r.score for r in rows) / sum(r.n_bytes for r in rows) * math.log2(10)
    assert len(rows) > 100 and bits < 2.9
