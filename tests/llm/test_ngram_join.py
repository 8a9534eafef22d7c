import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from encore.llm import ngram_join as J
from encore.llm.bytewords import LOWER, NOT_SPACE, pieces
from encore.llm.components import components
from tests.llm.helpers import ODD_TEXTS, documents, random_texts


def shingle_set(t, n):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(texts, n, similar):
    s = [shingle_set(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= similar * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s[i]), find(i)) for i in range(len(s))]


def near_copies(seed, families=25, size=8, words=(4, 90)):
    rng = random.Random(seed)
    out = []
    for _ in range(families):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(*words))]
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                k = rng.randrange(len(t))
                t[k:k + 1] = rng.choice([[], [f"x{rng.randint(0, 99)}"], [t[k].upper(), "new"], [t[k].upper()]]) or ["z"]
            out.append(" ".join(t))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n,similar,plan", [(3, 90, J.PLAN_90), (5, 80, J.PLAN_80), (3, 80, ((J.ALL, 4, 2, 6, 1),)), (2, 60, ((J.ALL, 1, 0, 4, 1),))])
def test_matches_brute_force(spark, n, similar, plan):
    texts = ODD_TEXTS + near_copies(n) + random_texts(40) + near_copies(n + 1, 3, 12, (300, 400))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           J.near_duplicates(documents(spark, texts), n, similar, plan).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, n, similar)


def test_chain_of_links_in_one_bucket(spark):
    """Neighbours link, the ends do not: the pairs that the star misses count."""
    words = [f"c{i}" for i in range(130)]
    texts = [" ".join(words[i:i + 100]) for i in range(0, 30, 3)]
    got = [r.component_id for r in J.near_duplicates(documents(spark, texts), 3, 90, J.PLAN_90).collect()]
    assert got == [0] * len(texts) == [c for _, c in brute(texts, 3, 90)]


@pytest.mark.parametrize("similar,plan", [(90, J.PLAN_90), (80, J.PLAN_80), (70, ((J.ALL, 4, 2, 6, 1),))])
def test_linked_sets_share_a_signature(similar, plan):
    rng = np.random.default_rng(similar)
    for size in [*range(1, 40), 100, 333, 1000, 4000]:
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for _ in range(8):
            gone = rng.integers(0, max(1, size * (100 - similar) // 150) + 1)
            new = rng.integers(0, 1 << 63, rng.integers(0, gone + 2)).astype(np.uint64)
            b = np.concatenate([a[gone:], new])
            same = size - gone
            if not len(b) or 100 * same < similar * (len(a) + len(b) - same):
                continue
            out = []
            for x in (a, b):
                d, s = J.signatures(np.zeros(len(x), np.int64), x, np.array([len(x)]), similar, plan)
                out.append(set(s.tolist()))
            assert out[0] & out[1], (len(a), len(b), same)


def test_sketch_never_exceeds_the_difference():
    for p in pieces(pa.array(near_copies(9) + near_copies(10, 3, 4, (1000, 3000)), pa.string()), NOT_SPACE, LOWER):
        doc, h, size = J.shingles(p, 3)
        sk, fine = J.sketches(doc, h, p.n), J.fine_sketches(doc, h, size).to_pylist()
        of = [set(h[doc == i].tolist()) for i in range(p.n)]
        for i in range(0, p.n, 3):
            for j in range(p.n):
                assert sum(int(x).bit_count() for x in (sk[i] ^ sk[j]).view(np.uint64)) <= len(of[i] ^ of[j])
                assert J.apart(fine[i], fine[j]) <= len(of[i] ^ of[j])


def test_repeats_nulls_and_clashing_names(spark):
    copies = ["a b c d e f"] * 5 + [None, "", " "] + ["x y z"] * 2
    docs = documents(spark, copies).selectExpr("*", "1 as cls", "2 as n_shingles", "3 as root", "4 as _gone")
    odd = docs.selectExpr("cast(null as long) as doc_id", *docs.columns[1:])
    got = J.near_duplicates(docs.union(docs).union(odd), 3, 90, J.PLAN_90).collect()
    assert len(got) == 30
    assert {r.component_id for r in got if r.n_shingles == 4} == {0} and {r.component_id for r in got if r.n_shingles == 1} == {8}
    assert sorted(r.component_id or -1 for r in got if r.n_shingles == 0) == [-1] * 3 + [5, 5, 6, 6, 7, 7]
    kept = J.keep_one(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 5, 5, 6, 6, 7, 7, 8]
    assert J.near_duplicates(docs.limit(0)).count() == 0 and J.keep_one(docs.limit(0)).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(spark):
    """Null ids and ids that restart stand for different texts: only copies go."""
    base = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdefg"]
    rows = [(None, base[0]), (None, base[1]), (None, base[1]), (None, base[2]), (1, base[2] + " more"),
            (2, base[3]), (2, base[4]), (3, base[4]), (2, base[4].upper()), (4, base[5]), (4, base[6]), (1, base[6]),
            (None, None), (2, " "), (9, base[3] + " more")]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as cls", "2 as of_group"))
    assert kept.columns == ["doc_id", "text", "cls", "of_group"]
    got = sorted(((r.doc_id, r.text and r.text.lower()) for r in kept.collect()), key=str)
    assert got == sorted([(None, base[0]), (None, base[1]), (1, base[2] + " more"), (2, base[3]), (2, base[4]), (4, base[5]),
                          (1, base[6]), (None, None), (2, " ")], key=str)
    assert [r.text for r in kept.collect() if r.text and r.doc_id == 2 and "e0" in r.text.lower()] == [base[4].upper()]
    plain = [(None, base[0]), (None, base[1])]
    assert J.keep_one(spark.createDataFrame(plain, "doc_id long, text string")).count() == 2


def test_survivor_of_repeated_rows_does_not_depend_on_order(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text.title(), 3), (1, text, 1), (1, text.upper(), 2), (1, text.upper(), 5), (1, text.replace(" ", "  "), 4)]
    schema = "doc_id long, text string, kept_row int"
    one = {J.keep_one(spark.createDataFrame(r, schema).repartition(n)).collect()[0] for r, n in ((rows, 1), (rows[::-1], 1), (rows, 5))}
    assert len(one) == 1 and one.pop().text == text.upper()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 450)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sql_matches_brute_force():
    texts = [t for t in ODD_TEXTS if t is None or "\x85" not in t] + near_copies(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = {i: (n, c) for i, n, c in con.execute(J.oracle(3, 90)).fetchall()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 3, 90)
