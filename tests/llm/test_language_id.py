import random
import unicodedata

import numpy as np
import pyarrow as pa

from encore.llm import language_id as L
from encore.llm import queries
from encore.llm.bytewords import LOWER, pieces
from tests.llm.helpers import ODD_TEXTS, documents

WORDS = {"aa": "thing reading water mother running", "bb": "und nicht über schön wasser", "cc": "слово вода мать дом",
         "dd": "λόγος νερό μητέρα"}


def made(n=400, seed=2):
    rng = random.Random(seed)
    langs = list(WORDS)
    texts = [" ".join(rng.choice(WORDS[langs[i % 4]].split()) for _ in range(rng.randint(3, 12))) for i in range(n)]
    return texts, langs


def model(spark, **kw):
    texts, langs = made()
    return L.learn(documents(spark, texts, langs=langs), **kw)


def test_learned_languages_and_scripts(spark):
    m = model(spark)
    assert m.languages == sorted(WORDS)
    texts, langs = made(80, 5)
    got = {r.doc_id: r for r in L.label(documents(spark, texts), m).collect()}
    assert all(got[i].lang_pred == langs[i % 4] and got[i].score > 0.9 for i in range(80))
    # a script narrows the candidates even for unseen words
    rows = L.label(documents(spark, ["щщщ жжж", "ωψ", "漢字"]), m).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:2]] == ["cc", "dd"] and rows[2].lang_pred in m.languages


def test_spans_of_mixed_text(spark):
    m = model(spark)
    parts = [("aa", "mother reading running water"), ("bb", "nicht über schön wasser und"), ("cc", "слово вода")]
    text = ". ".join(t for _, t in parts)
    r = L.label(documents(spark, [text]), m).first()
    assert [(s.lang, text[s.start:s.end]) for s in r.spans] == parts


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    m = L.Model(["a", "b", "c"], 4, np.zeros((16, 3)), np.zeros((1, 3)), 1.5)
    n = [0, 5, 1, 6, 0, 3, 6]
    at = np.concatenate([[0], np.cumsum(n)])
    score = rng.normal(size=(at[-1], 3)) * 2
    got = m.viterbi(score, at)

    def total(s, labels):
        return sum(s[i, x] for i, x in enumerate(labels)) - 1.5 * sum(a != b for a, b in zip(labels, labels[1:]))
    for i in range(len(n)):
        s, own = score[at[i]:at[i + 1]], got[at[i]:at[i + 1]]
        best = max(total(s, np.unravel_index(k, (3,) * n[i])) for k in range(3 ** n[i])) if n[i] else 0
        assert abs(total(s, list(own)) - best) < 1e-9


def test_word_scores_do_not_depend_on_neighbours(spark):
    m = model(spark)
    one = [m.words(p) for t in ["water", "слово"] for p in pieces(pa.array([t]), L.LETTERS, LOWER)]
    both = [m.words(p) for p in pieces(pa.array(["water", "слово"]), L.LETTERS, LOWER)]
    np.testing.assert_allclose(np.concatenate(one), np.concatenate(both))


def test_und_nulls_and_empty(spark):
    m = model(spark)
    docs = documents(spark, ODD_TEXTS + ["1234 …", "😀"]).selectExpr("*", "'x' as lang_pred", "1 as score", "2 as letter")
    for r in L.label(docs.union(docs), m).join(docs.select("doc_id", "text"), "doc_id").collect():
        letter = any(unicodedata.category(c)[0] == "L" for c in r.text or "")
        assert (r.lang_pred != "und") == letter and 0 <= r.score <= 1 and bool(r.spans) == letter
    assert L.label(docs.limit(0), m).count() == 0
    none = L.learn(docs.limit(0))
    assert {r.lang_pred for r in L.label(docs, none).collect()} == {"und"}


def test_signs_beyond_ascii_are_no_letters(spark):
    """Quotes and dashes that one language uses do not make others' words its own."""
    texts, langs = made()
    texts = [f"„{t.replace(' ', ' – ', 1)}“" if langs[i % 4] == "bb" else t for i, t in enumerate(texts)]
    m = L.learn(documents(spark, texts, langs=langs))
    text = "“mother” – ‘reading’ … „running“ 😀 «water»"
    r = L.label(documents(spark, [text]), m).first()
    assert (r.lang_pred, r.score) == ("aa", 1.0)
    assert [(s.lang, text[s.start:s.end]) for s in r.spans] == [("aa", "mother” – ‘reading’ … „running“ 😀 «water")]
    assert L.label(documents(spark, ["“…” – 12 ²"]), m).first().lang_pred == "und"


def test_scripts_by_code_point(spark):
    words = {"latin": ["a", "é", "ệ", "ſ", "ﬁ"], "greek": ["λ", "ἀ"], "cyrillic": ["ж", "ꙁ"], "georgian": ["ქ", "Ქ"], "hebrew": ["ש"],
             "arabic": ["ع", "ﺱ"], "devanagari": ["ह"], "bengali": ["ব"], "thai": ["ไ"], "han": ["漢", "𠀀", "々"], "kana": ["あ", "ｱ"],
             "hangul": ["한", "ᄀ"], "ethiopic": ["አ"], "other": ["𐌰", "𝒜"]}
    flat = [(name, w) for name, ws in words.items() for w in ws]
    for p in pieces(pa.array([" ".join(w for _, w in flat)]), L.LETTERS, LOWER):
        assert [L.SCRIPTS[k] for k in L._scripts(p)] == [name for name, _ in flat]
    # blocks are in order and apart, as the look-up needs
    assert all(a[2] < b[1] for a, b in zip(L.BLOCKS, L.BLOCKS[1:]))


def test_learning_counts_every_text(spark, monkeypatch):
    """A language with one text among many is learned, and flushing changes nothing."""
    texts, langs = made(200)
    docs = documents(spark, texts, langs=langs).union(documents(spark, ["quixotic zebra vexed jumping"], langs=["rare"]))
    whole = L.learn(docs)
    assert whole.languages == sorted([*WORDS, "rare"])
    assert L.label(documents(spark, ["zebra quixotic vexed"]), whole).first().lang_pred == "rare"
    monkeypatch.setattr(L, "HELD", 1)
    np.testing.assert_allclose(L.learn(docs).logp, whole.logp)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language_id(spark, sf).join(docs, "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and len(rows) > 100
