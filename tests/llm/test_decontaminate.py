import hashlib
import random
import re

from encore.llm import decontaminate as D
from encore.llm import queries
from tests.harness import compare, duck
from tests.llm.helpers import ODD_TEXTS, documents, random_texts


def words(t):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def brute(text, items, window=10):
    w, hit, names = words(text), set(), set()
    for name, t in items:
        v = words(t)
        k = min(window, len(v))
        for j in range(len(v) - k + 1 if k else 0):
            for i in range(len(w) - k + 1):
                if w[i:i + k] == v[j:j + k]:
                    hit |= set(range(i, i + k))
                    names.add(name)
    return len(w), len(hit), sorted(names)


def case(seed=3):
    rng = random.Random(seed)
    items = [("" if i % 19 == 5 else str(i), t) for i, t in enumerate(random_texts(40, seed, 25, 9) + ["w1 w2", "The", "", "w3 w3 w3"])]
    texts = ODD_TEXTS + random_texts(80, seed + 1, 60, 9)
    for _ in range(60):
        t = random_texts(1, rng.random(), 30, 30)[0].split()
        p = words(rng.choice(items)[1])
        cut = rng.randint(0, max(0, len(p) - 10))
        texts.append(" ".join(t + [x.upper() if rng.random() < .3 else x for x in p[cut:cut + rng.randint(8, 14)]] + t[:3]))
    return texts, items


def run(spark, texts, items):
    bench = spark.createDataFrame([(int(i) if i else None, t) for i, t in items] + [(None, None)], "item_id long, text string")
    docs = documents(spark, texts).selectExpr("*", "7 as hits", "8 as n_words")
    return docs, bench


def test_matches_brute_force(spark):
    texts, items = case()
    docs, bench = run(spark, texts, items)
    rows = {r.doc_id: r for r in D.digest(D.scan(docs, bench)).collect()}
    assert len(rows) == len(texts) and any(r.n_hit for r in rows.values())
    for i, t in enumerate(texts):
        n, hit, names = brute(t, items)
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0), (t, names)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()


def test_blocks_and_rounds_agree(spark, monkeypatch):
    texts, items = case(11)
    docs, bench = run(spark, texts, items)
    want = sorted(D.digest(D.scan(docs, bench)).collect())
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    monkeypatch.setattr(D, "ROUND_BYTES", 2000)
    assert sorted(D.digest(D.scan(docs, bench)).collect()) == want


def test_automata_hold_only_what_a_batch_shares(monkeypatch):
    """A benchmark of 3 MB, more than a block: an automaton per block of items that
    the batch shares windows with, built once however many pieces the batch has."""
    import pyarrow as pa
    rng = random.Random(2)
    items = [(str(i), " ".join(f"b{rng.randint(0, 99999)}" for _ in range(40))) for i in range(12000)]
    index = D.Index(items, 10)
    shared = [items[i][1] for i in (5, 700, 11999)]
    texts = [f"start {shared[j % 3]} end " + "plain words " * 2000 if j % 7 == 0 else "plain words " * 3000 for j in range(60)]
    built = []
    block = D.Block
    monkeypatch.setattr(D, "Block", lambda part, window: built.append([x[0] for x in part]) or block(part, window))
    rows = D.hits_of(pa.array(texts), index)
    assert built == [["5", "700", "11999"]]
    for j, r in enumerate(rows):
        assert (r["n_hit"], r["items"]) == ((40, [["5", "700", "11999"][j % 3]]) if j % 7 == 0 else (0, []))
    assert D.hits_of(pa.array(["nothing shared"] * 5), index)[0]["n_hit"] == 0 and len(built) == 1


def test_clean_cuts_spans_and_drops_covered_rows(spark):
    passage = " ".join(f"q{i}" for i in range(12))
    docs = documents(spark, ["é " * 20 + passage.upper() + "! ñ end", passage, "clean text", None, ""])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r.text for r in D.clean(docs, bench).collect()}
    assert got == {0: "é " * 20 + "! ñ end", 2: "clean text", 3: None, 4: ""}
    assert D.clean(docs, bench).columns == docs.columns


def test_empty_tables(spark):
    docs = documents(spark, ["a b c"] + ODD_TEXTS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.digest(D.scan(docs, bench)).filter("contaminated").count() == 0
    assert D.scan(docs.limit(0), bench).count() == 0


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    ok, why = compare(queries.op4_decontaminate(spark, sf), D.ORACLE, duck(sf))
    assert ok, why
