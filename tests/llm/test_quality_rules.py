import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from encore.llm import quality_rules as Q
from tests.llm.helpers import ODD_TEXTS, documents, random_texts

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] >= 2:
            hit |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def test_statistics_match_brute_force():
    texts = ODD_TEXTS + random_texts(300, vocab=8) + random_texts(50, seed=2, words=400, vocab=12)
    got = Q.statistics(pa.array(texts, pa.string()))
    assert [tuple(int(got[c][i]) for c in Q.COUNTS) for i in range(len(texts))] == [brute(t) for t in texts]


def test_statistics_in_small_pieces(monkeypatch):
    texts = ODD_TEXTS + random_texts(60, vocab=8)
    whole = Q.statistics(pa.array(texts, pa.string()))
    old = Q.pieces
    monkeypatch.setattr(Q, "pieces", lambda t, w: old(t, w, size=16))
    small = Q.statistics(pa.array(texts, pa.string()))
    for c in Q.COUNTS + Q.EXTRA:
        np.testing.assert_array_equal(whole[c], small[c])


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    f = Q.grow(x)
    assert f.score(np.array([[9.0, 9.0, 9.0]]))[0] > f.score(x).mean() + 0.1


def test_calibrate_bounds_loss():
    assert Q.calibrate([(1, 10, 990), (1, 60, 10), (0, 70, 50), (0, 10, 5)], 100, 0.02) == pytest.approx(0.61, abs=0.1)
    assert Q.calibrate([(1, 10, 5)], 100, 0.02) == float("inf")


def _clean(n):
    return [" ".join(f"word{(i * 31 + j * 17) % 997}" for j in range(80)) for i in range(n)]


def test_judge_and_reject(spark):
    texts = _clean(60) + [t.replace(" ", "### ") for t in _clean(6)] + ODD_TEXTS
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(66)] + [(0, 1), (None, 1), (5000, 0)],
                                   "doc_id long, quality int")
    rows = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    assert len(rows) == len(texts)
    assert all(rows[i].kept for i in range(60))
    assert not any(rows[i].kept for i in range(60, len(texts)) if rows[i].n_words)
    forest = Q.fit(Q.rule_statistics(docs), labels)
    clash = docs.withColumn("kept", docs.doc_id * 0).withColumn("n_words", docs.doc_id)
    got = Q.reject(clash, forest)
    assert got.columns == clash.columns
    assert {r.doc_id for r in got.collect()} == {i for i, r in rows.items() if r.kept}


def test_no_labels_and_empty(spark):
    docs = documents(spark, _clean(5))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.judge(docs, none).filter("kept").count() == 5
    assert Q.judge(docs.limit(0), none).count() == 0


def test_paths_match_brute_force():
    """Scores are 2^(-mean path / expected path), each path walked node by node."""
    rng = np.random.default_rng(1)
    x = rng.exponential(size=(300, 4)).round(1)
    f = Q.grow(x, n_trees=20, subsample=64)

    def path(tree, row, node=0, depth=0):
        feat, split, left, right, leaf = tree
        if feat[node] < 0:
            return leaf[node], depth
        return path(tree, row, left[node] if row[feat[node]] < split[node] else right[node], depth + 1)
    harmonic = 2 * sum(1 / i for i in range(1, 64)) - 2 * 63 / 64
    for row, got in zip(x[:40], f.score(x[:40])):
        paths = [path(t, row) for t in f.trees]
        assert all(depth <= leaf and depth <= 6 for leaf, depth in paths)
        assert abs(got - 2 ** (-np.mean([leaf for leaf, _ in paths]) / harmonic)) < 0.002


def test_usual_is_learned(spark):
    """Faults far below any fixed limit are seen where good rows have none."""
    clean = _clean(300)

    def faulty(t):
        w = t.split()
        return " ".join(f"{x}!" if i % 16 == 0 else x for i, x in enumerate(w))
    texts = clean + [faulty(t) for t in clean[:20]]
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(320)], "doc_id long, quality int")
    rows = {r.doc_id: r.kept for r in Q.judge(documents(spark, texts), labels).collect()}
    assert all(rows[i] for i in range(300)) and not any(rows[i] for i in range(300, 320))


def test_band_and_distance():
    band = Q.usual(np.array([[1.0] * 6, [3.0] * 6]), 0.0, 0.25)
    assert band.tolist() == [[0.5] * 6, [3.5] * 6]
    np.testing.assert_allclose(Q.beyond(np.array([[0.0, 2, 3.5, 4, 0.5, 10]]), band), [[0.5, 0, 0, 0.5, 0, 6.5]])
    assert not Q.beyond(np.ones((2, 6)), Q.usual(np.zeros((0, 6)), 0.1, 0.1)).any()
