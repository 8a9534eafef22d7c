import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from encore.llm import queries
from encore.llm import toxicity as X
from encore.llm.bytewords import NOT_SPACE, pieces
from tests.llm.helpers import ODD_TEXTS, documents


def subsequences(word, decay):
    out = Counter()
    for i, j, k in combinations(range(len(word)), 3):
        if k - i <= X.REACH:
            out[word[i] + word[j] + word[k]] += decay ** (k - i - 2)
    return out


def brute(a, b, decay=0.7):
    norm = lambda w: sum(decay ** (2 * (k - i - 2)) for i, j, k in combinations(range(len(w)), 3) if k - i <= X.REACH) ** 0.5
    x, y = subsequences(a, decay), subsequences(b, decay)
    return sum(v * y[s] for s, v in x.items()) / max(norm(a) * norm(b), 1e-9)


def test_kernel_matches_brute_force():
    marks, words = ["idiot", "trash", "worthless", "aaaa"], ["idiot", "idixot", "trashy", "a", "ab", "abc", "aaaaaa", "hopeless", "tr" * 30]
    row, table = X._tables(marks, 0.7)
    got = X.Model(marks, 0.7, row, table).kernel(*X._packed(words), block=4)
    want = [[brute(w, m) for m in marks] for w in words]
    np.testing.assert_allclose(got, want, rtol=1e-5, atol=1e-6)
    assert brute("idixot", "idiot") > 0.5 > brute("studio", "idiot")


def words(text):
    out = []
    for p in pieces(pa.array([text]), NOT_SPACE):
        letters, s, e, _ = X.words_of(p)
        out += [letters[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)]
    return out


def test_words_undo_disguises():
    assert words("1d10t i.d.i.o.t I D I O T! a b x") == ["idiot", "idiot", "idiotabx"]
    assert words("you are a tr@$h -- é a") == ["you", "are", "a", "trash", "é", "a"]
    assert words("... !!") == [] and words("") == []


def table(n=400, seed=3):
    rng = random.Random(seed)
    bag = ["water", "house", "garden", "river", "mountain", "window", "teacher", "market", "idea", "trail", "wordless"]
    bad = ["idiot", "worthless", "moron"]
    texts, labels = [], []
    for i in range(n):
        t = [rng.choice(bag) for _ in range(rng.randint(10, 60))]
        if i % 5 == 0:
            for _ in range(2):
                t[rng.randrange(len(t))] = rng.choice(bad)
        texts.append(" ".join(t))
        labels.append((i, int(i % 5 == 0)))
    return texts, labels


@pytest.fixture(scope="module")
def model(spark):
    texts, labels = table()
    return X.learn(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_disguised_insults(spark, model):
    texts = ["the water of an idiot house", "an id-i-ot garden river", "what a m0r0n window", "w o r t h l e s s market",
             "morron water house", "water house garden river", "idea trail wordless window", "market " * 3000]
    got = [r.predicted for r in X.score(documents(spark, texts), model).orderBy("doc_id").collect()]
    assert got == [1, 1, 1, 1, 1, 0, 0, 0]


def test_cache_does_not_change_scores(model, monkeypatch):
    texts = pa.array(table(50, 9)[0] + ODD_TEXTS, pa.string())
    want = model.score(model.closest(texts, {}))
    cache = {}
    model.closest(texts, cache)
    np.testing.assert_allclose(model.score(model.closest(texts, cache)), want, atol=1e-6)
    monkeypatch.setattr(X, "CACHE", 10)
    np.testing.assert_allclose(model.score(model.closest(texts, {})), want, atol=1e-6)


def test_odd_rows_and_missing_labels(spark, model):
    docs = documents(spark, ODD_TEXTS).selectExpr("*", "1 as score", "2 as toxic", "3 as predicted")
    rows = X.score(docs.union(docs), model).collect()
    assert len(rows) == 2 * len(ODD_TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert X.score(docs.limit(0), model).count() == 0
    for labels in ([], [(0, 0)], [(None, 1), (3, None)]):
        none = X.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {(r.score, r.predicted) for r in X.score(docs, none).collect()} == {(0.0, 0)}


def test_learning_is_repeatable(spark, model):
    texts, labels = table()
    docs, marks = documents(spark, texts).repartition(7), spark.createDataFrame(labels, "doc_id long, toxic int").repartition(3)
    again = X.learn(docs, marks)
    assert again.landmarks == model.landmarks
    np.testing.assert_allclose(again.weights, model.weights, rtol=1e-6)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op8_toxicity(spark, sf).filter("held_out").join(marks, "doc_id").toPandas()
    bad = rows["toxic"] == 1
    rank = rows["score"].rank()
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / bad.sum() / (~bad).sum()
    assert auc > 0.96 and ((rows["score"] >= 0.5) == bad).mean() > 0.96


def test_likelihood_ratio(spark):
    rows = [(3, 0, 10, 40), (5, 5, 10, 40), (10, 0, 10, 40), (10, 39, 10, 40), (2, 1, 10, 40)]
    from math import log
    for a, b, na, nb in rows:
        got = spark.createDataFrame([(a, b)], "a long, b long").select(X._likelihood_ratio(F.col("a"), F.col("b"), na, nb)).first()[0]
        ll = lambda k, n, p: (k * log(p) if k else 0) + ((n - k) * log(1 - p) if n > k else 0)
        p = (a + b) / (na + nb)
        assert abs(got - (ll(a, na, a / na) + ll(b, nb, b / nb) - ll(a, na, p) - ll(b, nb, p))) < 1e-6


def test_repeated_labelled_ids_are_one(spark):
    """Any number of rows with one id adds one text to what is learned."""
    texts, labels = table(120)
    docs, marks = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    hot = docs.union(docs.filter("doc_id = 7").crossJoin(spark.range(300)).drop("id"))
    a, b = X.learn(docs, marks), X.learn(hot, marks)
    assert a.landmarks == b.landmarks and np.allclose(a.weights, b.weights)
