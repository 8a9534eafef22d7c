import random

import numpy as np
import pyarrow as pa
import pytest

from encore.llm import bbit_minhash as B
from encore.llm.bytewords import LOWER, NOT_SPACE, pieces
from encore.llm.ngram_join import shingles
from tests.llm.helpers import ODD_TEXTS, documents, random_texts, settled, shuffles
from tests.llm.test_ngram_join import brute, near_copies


@pytest.mark.parametrize("n,similar", [(3, 85), (5, 80)])
def test_matches_brute_force(spark, n, similar):
    texts = ODD_TEXTS + near_copies(n) + random_texts(40) + near_copies(n + 1, 3, 12, (300, 400))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in B.near_duplicates(documents(spark, texts), n, similar).collect()}
    want = [(s, c, c == i) for i, (s, c) in enumerate(brute(texts, n, similar))]
    assert [got[i] for i in range(len(texts))] == want


def test_chain_of_links(spark):
    """Neighbours link and the ends do not: pairs that the least class misses count."""
    words = [f"c{i}" for i in range(160)]
    texts = [" ".join(words[i:i + 100]) for i in range(0, 48, 4)]
    got = B.near_duplicates(documents(spark, texts), 3, 85).collect()
    assert {r.component_id for r in got} == {0} and brute(texts, 3, 85)[-1][1] == 0
    assert sum(r.kept for r in got) == 1


def test_many_near_copies_share_buckets(spark):
    """A large group: edits of one text, with strangers that share a passage."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = f"x{rng.randint(0, 999)}"
        texts.append(" ".join(t))
    texts += [" ".join(base[:90] + [f"y{i}_{j}" for j in range(20)]) for i in range(30)]
    got = {r.doc_id: r.component_id for r in B.near_duplicates(documents(spark, texts), 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute(texts, 3, 85)]


def test_finished_steps_keep_no_shuffle_files(spark):
    """Some fifty shuffles come before the last step; only those of small counts stay."""
    before = shuffles(spark)
    got = B.near_duplicates(documents(spark, near_copies(3)), 3, 85)
    assert settled(lambda: len(shuffles(spark) - before) <= 8)
    assert got.count() == len(near_copies(3))


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.3, 0.85, 1.0):
        got = []
        for _ in range(30):
            same = int(400 * share)
            a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
            b = np.concatenate([a[:same], rng.integers(0, 1 << 63, 400 - same).astype(np.uint64)])
            s = [B.packed(B.minima(np.zeros(400, np.int64), x, np.array([400]))).view(np.uint64)[0] for x in (a, b)]
            planes = (s[0] ^ s[1]).reshape(B.BITS, -1)
            equal = B.SLOTS - int(np.bitwise_count(np.bitwise_or.reduce(planes, axis=0)).sum())
            got.append((equal / B.SLOTS - 0.25) / 0.75)
        jaccard = same / (800 - same)
        assert abs(np.mean(got) - jaccard) < 0.03
        if share == 1.0:
            assert min(got) == 1.0


def test_candidates_and_cutoff_lose_no_link():
    """Slots that agree at random with a chance of 0.85: bands meet, estimates pass."""
    rng = np.random.default_rng(5)
    agree = rng.random((100_000, B.SLOTS)) < 0.85
    met = np.zeros(len(agree), bool)
    for band in B.BANDS:
        met |= agree[:, band].all(1)
    assert met.all()
    collided = agree | (rng.random(agree.shape) < 0.25)
    assert (collided.sum(1) >= B.least_equal(85)).all()
    assert B.least_equal(85) / B.SLOTS > 0.7


def test_signatures_do_not_depend_on_the_piece():
    texts = near_copies(4, 10) + ["", None, "a"]
    by_size = []
    for size in (50, 1 << 18):
        rows = []
        for p in pieces(pa.array(texts, pa.string()), NOT_SPACE, LOWER, size):
            doc, h, n = shingles(p, 3)
            least = B.minima(doc, h, n)
            rows += [(s.tobytes(), k.tobytes()) for s, k in zip(B.packed(least), B.band_keys(least), strict=True)]
        by_size.append(rows)
    assert by_size[0] == by_size[1] and len(by_size[0]) == sum(bool(t) for t in texts)


def test_repeats_nulls_and_clashing_names(spark):
    copies = ["a b c d e f"] * 5 + [None, "", " "] + ["x y z"] * 2
    docs = documents(spark, copies).selectExpr("*", "1 as cls", "2 as n_shingles", "3 as bands", "4 as kept")
    odd = docs.selectExpr("cast(null as long) as doc_id", *docs.columns[1:])
    got = B.near_duplicates(docs.union(docs).union(odd), 3, 85).collect()
    assert len(got) == 30 and got[0].asDict().keys() == {"doc_id", "n_shingles", "component_id", "kept"}
    assert {r.component_id for r in got if r.n_shingles == 4} == {0} and {r.component_id for r in got if r.n_shingles == 1} == {8}
    assert sum(r.kept for r in got if r.n_shingles == 4) == 2
    assert all(r.kept for r in got if r.n_shingles == 0)
    only_null = B.near_duplicates(odd, 3, 85).collect()
    assert {r.component_id for r in only_null} == {None}
    assert B.near_duplicates(docs.limit(0)).count() == 0
