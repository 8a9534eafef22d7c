import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pyarrow as pa
import pytest

from encore.llm import importance as I
from encore.llm.bytewords import ALNUM, LOWER, pieces
from tests.llm.helpers import ODD_TEXTS, documents, random_texts


def words(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams(t, longest=2):
    w = words(t)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def bucket(f, buckets=10_000):
    return zlib.crc32(f.encode()) % buckets


def brute(rows, target, percent=25, min_words=20, buckets=10_000):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(bucket(f, buckets) for f in grams(text))
    for text in target:
        t.update(bucket(f, buckets) for f in grams(text))
    alls, allt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (alls + buckets) / ((s[b] + 1) * (allt + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        g = [gain[bucket(f, buckets)] for f in grams(text)]
        weight = sum(g) // len(g) if g else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    enough = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(enough[:percent * len(enough) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_buckets_compose_from_payloads():
    rng = random.Random(1)
    bag = ["the", "Cat", "été", "漢字", "x" * 70, "y" * 63, "z" * 64, "q" * 3000, *(f"w{i}" for i in range(50))]
    texts = [*ODD_TEXTS, *(" ".join(rng.choices(bag, k=rng.randint(0, 40))) for _ in range(200))]
    dictionary = I.Dictionary(40)
    for size in (300, 1000, 1 << 18):            # the dictionary learns and fills up meanwhile
        for p in pieces(pa.array(texts, pa.string()), ALNUM, LOWER, size):
            doc, got = I.features(p, dictionary, 3, 10_000)
            want = [(i, bucket(f)) for i in range(p.n) for f in grams(texts[p.first + i], 3)]
            assert sorted(zip(doc.tolist(), got.tolist(), strict=True)) == sorted(want)
    assert len(dictionary.known) == 40


@pytest.mark.parametrize("length", [0, 1, 5, 63, 64, 65, 1000])
def test_compose(length):
    import numpy as np
    a, b = b"left " * 3, bytes(range(256)) * 4
    got = I.compose(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b[:length])], np.uint32), np.array([length]))
    assert int(got[0]) == zlib.crc32(a + b[:length])


def test_matches_brute_force(spark):
    texts = ODD_TEXTS + random_texts(300, words=60)
    target = [*random_texts(10, seed=5, vocab=20), None, ""]
    docs = documents(spark, texts)
    got = I.importance(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in got} == \
        {r[0]: r[1:] for r in brute(list(enumerate(texts)), target)}


def test_repeats_nulls_ties_and_names(spark):
    texts = ["a b " * 30, "c d " * 30, None, "", "short"]
    rows = [(i, t) for i, t in enumerate(texts)] * 8 + [(None, texts[0])] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as weight", "2 as Rank", "3 as score")
    target = spark.createDataFrame([("c d",)], "text string")
    got = I.importance(docs, target, keep=("doc_id", "weight", "Rank", "score"), weight="_weight").collect()
    assert list(got[0].asDict()) == ["doc_id", "weight", "Rank", "score", "n_words", "n_features", "_weight", "_score", "_rank"]
    assert len(got) == len(rows)
    ranks = sorted(r["_rank"] for r in got if r["_rank"])
    assert ranks == list(range(1, 56 * 25 // 100 + 1))
    by_rank = [r["_score"] for r in sorted((r for r in got if r["_rank"]), key=lambda r: r["_rank"])]
    assert by_rank == sorted(by_rank, reverse=True)
    assert {r["n_features"] for r in got if r.doc_id in (2, 3)} == {0}
    empty = I.importance(docs.select("doc_id", "text").limit(0), target.limit(0))
    assert empty.count() == 0
    no_target = I.importance(docs.select("doc_id", "text"), target.limit(0))
    assert no_target.count() == len(rows)
