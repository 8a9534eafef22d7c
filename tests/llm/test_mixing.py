from collections import defaultdict

import pytest

from encore.llm import mixing, queries
from tests.harness import compare, duck
from tests.llm.helpers import ODD_TEXTS, documents, random_texts


def fill(sizes, weights, total, most):
    """Share by weight, hold what is above its limit, share the rest again."""
    held = {}
    while True:
        left = total - sum(held.values())
        open_ = [s for s in sizes if s not in held]
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > most * sizes[s]] if w else []
        if not over:
            return {**held, **{s: left * weights[s] / w for s in open_}}
        held.update({s: most * sizes[s] for s in over})


def test_targets_match_repeated_sharing(spark):
    texts = ["w " * n for n in (900, 5, 40, 0, 3, 77, 200, 1, 15)]
    rows = [(i, t, None if i == 4 else f"s{i}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: r for r in mixing.targets(df).collect()}
    order = sorted((s for s in got if s is not None)) + [None]
    sizes = {s: got[s].source_size for s in order}
    want = fill(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), 3)
    for s in order:
        assert got[s].target == pytest.approx(want[s]), s
    assert sum(r.target for r in got.values()) == pytest.approx(sum(sizes.values()))


def test_oracle(spark, tmp_path):
    assert compare(queries.op6_mixing(spark, "/root/testdata/sf0.01"), mixing.ORACLE, duck("/root/testdata/sf0.01"))[0]


def test_mix_comes_near_its_targets_and_repeats(spark):
    docs = documents(spark, random_texts(4000, words=60))
    planned = mixing.plan(docs)
    out = mixing.emit(planned)
    assert out.columns == docs.columns + ["copy"]
    per = defaultdict(int)
    for r in out.collect():
        per[r.source] += len((r.text or "").split())
    for r in mixing.targets(docs).collect():
        assert per[r.source] == pytest.approx(r.target, rel=0.1)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.emit(mixing.plan(docs)).collect()))


def test_null_and_repeated_ids_come_near_their_targets(spark):
    """Half the ids null, ids that restart, and one row a third of a source: each has its own draw."""
    texts = random_texts(4000, words=60)
    rows = [(None if i % 2 else i % 50, t, f"s{i % 3}") for i, t in enumerate(texts)] + [(None, "same words here", "s0")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    planned = mixing.plan(docs)
    assert planned.count() == len(rows) and planned.columns == [*docs.columns, "mix"]
    taken = planned.groupBy("source").agg({"mix.target": "max"}).collect()
    per = {r.source: r.t for r in planned.selectExpr("source", "mix.size * mix.copies as t").groupBy("source").agg({"t": "sum"})
           .withColumnRenamed("sum(t)", "t").collect()}
    for r in taken:
        assert per[r.source] == pytest.approx(r[1], rel=0.06)
    copies = [r.c for r in planned.filter("text = 'same words here'").selectExpr("mix.copies as c").collect()]
    assert len(set(copies)) == 2
    again = mixing.plan(docs.repartition(3))
    assert sorted(map(str, planned.collect())) == sorted(map(str, again.collect()))


def test_odd_rows(spark):
    docs = documents(spark, ODD_TEXTS).selectExpr("*", "1 as mix", "2 as copy", "'x' as target")
    docs = docs.union(docs).union(docs.selectExpr("cast(null as long)", *docs.columns[1:]))
    planned = mixing.plan(docs)
    assert planned.count() == 3 * len(ODD_TEXTS) and planned.columns == docs.columns + ["_mix"]
    assert set(mixing.emit(planned).columns) == set(docs.columns) | {"_copy"}
    assert planned.filter("_mix.copies > 3 or _mix.copies < 0").count() == 0
    assert mixing.emit(mixing.plan(docs.limit(0))).count() == 0
