import re
from collections import Counter

import corpus_pipeline as P
from encore.llm import mixing, pii
from tests.llm import test_decontaminate, test_ngram_join, test_quality_rules
from tests.llm.helpers import DOC_SCHEMA, ODD_TEXTS, documents, save

PASSAGE = " ".join(f"item{i}" for i in range(15))


def _texts():
    clean = test_quality_rules._clean(40)
    near = [clean[i] + " one more word here" for i in range(0, 10)]
    leaks = [clean[i][::-1] + " " + PASSAGE.upper() + " tail" for i in range(5)]
    private = [" ".join(f"v{i}x{j * 7 % 93}" for j in range(80)) + " mail a.b@c.org" for i in range(5)]
    junk = [t.replace(" ", "### ") for t in clean[:6]]
    return clean + near + leaks + private + junk + ODD_TEXTS


def _setup(spark, path):
    texts = _texts()
    save(documents(spark, texts).repartition(3), path, "documents")
    save(spark.createDataFrame([(i, int("###" not in (t or "###")), 0) for i, t in enumerate(texts) if i % 2 == 0],
                               "doc_id long, quality int, toxic int"), path, "labels")
    save(spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string"), path, "benchmark")
    return texts


def test_run_matches_stage_by_stage_brute_force(spark, tmp_path):
    sf = str(tmp_path)
    texts = _setup(spark, sf)
    rows = P.run(spark, sf).collect()
    # quality: the forest must leave clean texts and take all marked junk
    kept = [i for i, t in enumerate(texts) if t and "###" not in t
            and test_quality_rules.brute(t)[0] >= 50 and 100 * test_quality_rules.brute(t)[4] <= 50 * test_quality_rules.brute(t)[0]]
    roots = test_ngram_join.brute([texts[i] for i in kept], 5, 80)
    kept = [d for k, d in enumerate(kept) if roots[k][1] == k]
    want = {}
    for i in kept:
        t = re.sub("(?i)" + PASSAGE, "", texts[i])
        assert not test_decontaminate.brute(t, [("1", PASSAGE)])[1]
        want[i] = pii.mask(t)
    got = Counter(r.doc_id for r in rows)
    assert set(got) <= set(want) and all(r.text == want[r.doc_id] and r.n_chars == len(r.text) for r in rows)
    plan = {r.doc_id: r.mix.copies for r in mixing.plan(spark.createDataFrame(
        [(i, t, None, documents(spark, texts).filter(f"doc_id={i}").first().source, 0) for i, t in want.items()], DOC_SCHEMA)).collect()}
    assert got == Counter({i: c for i, c in plan.items() if c})


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    _setup(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for part in (docs, docs.limit(0)):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, part, sf)
            assert out.columns == docs.columns, name
            out.count()
    assert P.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
