import random
import re

import pyarrow as pa
import pytest

from encore.llm import periodic_runs as P
from encore.llm.bytewords import NOT_SPACE, pieces
from tests.llm.helpers import ODD_TEXTS, documents


def brute(w, least=6, repeats=4):
    out, seen = [], set()
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q) and (i, j) not in seen:
                out.append((i, j - i + q, q))
            if j > i:
                seen.update((i, j - m + q) for m in range(q, j - i + q, q))   # as a multiple of this period
            i = max(j, i + 1)
    kept = {}
    for s, n, q in sorted(out, key=lambda r: r[2]):
        kept.setdefault((s, n), (s, n, q))
    return sorted(kept.values(), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        bag, t = [chr(97 + i) for i in range(rng.randint(1, 5))], []
        for _ in range(rng.randint(0, 8)):
            unit = [rng.choice(bag) for _ in range(rng.randint(1, 7))]
            t += unit * rng.choice([1, 1, 2, 3, 4, 5, 6]) + unit[:rng.randint(0, len(unit))]
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("least,repeats", [(6, 4), (5, 3), (7, 5), (20, 4)])
def test_runs_match_brute_force(least, repeats):
    texts = repetitive(600, least)
    n = 0
    for p in pieces(pa.array(texts), NOT_SPACE, size=2000):
        got = [[] for _ in range(p.n)]
        for s, length, q in zip(*(x.tolist() for x in P.runs_of(p, least, repeats)), strict=True):
            doc = int((p.word_at <= s).sum()) - 1
            got[doc].append((s - int(p.word_at[doc]), length, q))
        for i in range(p.n):
            want = brute(texts[p.first + i].split(), least, repeats)
            assert got[i] == want, texts[p.first + i]
            n += len(want)
    assert n > 100


def test_long_texts_take_no_square():
    for text in ("a b " * 200_000, " ".join(random.Random(3).choices("abc", k=300_000))):
        runs = [P.runs_of(p) for p in pieces(pa.array([text]), NOT_SPACE)]
        assert sum(len(r[0]) for r in runs) > 0


def test_segments_are_split_until_stable():
    """c is rare in the text; without it a is rare on either side."""
    words = "a a c a a b b b b b b c".split()
    ids = {w: i for i, w in enumerate(sorted(set(words)))}
    import numpy as np
    start, end = P.segments(np.array([ids[w] for w in words]), np.array([0]), np.array([len(words)]), 4, 4)
    assert list(zip(start.tolist(), end.tolist(), strict=True)) == [(5, 11)]


def test_collapse_keeps_columns_and_odd_texts(spark):
    texts = [*ODD_TEXTS, *repetitive(60, 9), "Été " * 9 + "x  y", "a " * 20000 + "b"]
    docs = documents(spark, texts).selectExpr("*", "1 as runs", "2 as _RUNS")
    rows = P.collapse(docs.union(docs)).collect()
    assert len(rows) == 2 * len(texts) and list(rows[0].asDict()) == [*docs.columns, "__runs"]
    for r in rows:
        w = re.findall("[^\x20\x09-\x0d]+", texts[r.doc_id] or "")
        want = brute(w)
        assert [tuple(x) for x in r["__runs"]] == want
        assert r.text == (None if texts[r.doc_id] is None else collapsed(w, want))
    assert P.collapse(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.collapse(docs, repeats=2)


def test_digest(spark):
    docs = documents(spark, ["x " + "a b " * 4 + "c c c c c c", "", None, "no run"])
    got = P.digest(P.collapse(docs)).orderBy("doc_id").collect()
    assert [(r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in got] == \
        [(2, 9, 6, 1, 6000), (0, None, None, None, None), (0, None, None, None, None), (0, None, None, None, None)]
    assert len({r.runs_sha256 for r in got[1:]}) == 1 and got[1].collapsed_sha256 == got[2].collapsed_sha256
    odd = spark.createDataFrame([(None, "a a a a a a a b"), (None, None)], "doc_id long, text string")
    planted = odd.select("doc_id", P.planted().alias("text"))
    assert {r.n_runs for r in P.digest(P.collapse(planted)).collect()} == {0, 1}
