import hashlib
import random

import pytest
from pyspark.sql import functions as F

from encore.llm import chat_template as C
from encore.llm import queries
from tests.harness import compare, duck
from tests.llm.helpers import ODD_TEXTS

SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = ODD_TEXTS + ["<", "<\\", "<|", "<\\|", "<\\\\|x", "|", "<<|", "\n", "a\n<|im_start|>user\nb", "<|im_end|>\n", "\\n", "<|im_end|"]


def whole(template, **env):
    return "".join(t for t, _ in C.compile_template(template)(**env))


def test_language():
    assert whole("a{{ 'b' | upper ~ 1 + 2 }}c") == "aB12c"
    assert whole("{% if x == 'y' and not z %}1{% elif x in 'abc' %}2{% else %}3{% endif %}", x="b") == "2"
    assert whole("{% for m in ms %}{% if loop.first %}<{% endif %}{{ m.k }}{{ loop.index0 }}{% endfor %}", ms=[{"k": "a"}, {"k": None}]) == "<a01"
    assert whole("{{ x.y }}{{ missing }}{{ (none or 'd') }}", x="text") == "d"
    for b in (None, 7, {}, [], "xyz"):
        assert whole("{% if a in b %}1{% else %}2{% endif %}", a=1, b=b) == whole("{% if 1 in missing %}1{% else %}2{% endif %}") == "2"
    assert whole("{% if a in b %}1{% endif %}", a=1, b="x1") == whole("{% if a in b %}1{% endif %}", a=1, b=[1]) == "1"
    assert list(C.compile_template("u{% generation %}{{ a }}{% endgeneration %}v")(a="A")) == [("u", False), ("A", True), ("v", False)]


def test_folding():
    assert C.fold(C.parse("a{{ 'b' }}{% if 1 == 2 %}x{{ y }}{% else %}c{% endif %}")) == ("text", "abc")
    assert C.fold(C.parse("{{ y | trim }}{% if not true %}{% endif %}")) == ("out", ("filter", ("var", "y"), "trim"))


@pytest.mark.parametrize("bad", ["{{ x() }}", "{{ x.__class__ }}", "{{ _x }}", "{{ x | eval }}", "{% import os %}", "{{ x[0] }}",
                                 "{% for x %}{% endfor %}", "{% if x %}", "{% endif %}", "{{ }}", "{{ 'a' 'b' }}", "{% else %}", "{{ ('a' }}"])
def test_sandbox_and_errors(bad):
    with pytest.raises(C.TemplateError):
        whole(bad, x={})


def test_values_are_never_templates_and_attributes_never_read():
    class Thing:
        secret = "s"
    assert whole("{{ a }}{{ b.secret }}", a="{{ b }}", b=Thing()) == "{{ b }}"


def test_escapes_are_reversible_and_hide_controls():
    rng = random.Random(1)
    for s in TRICKY[1:] + ["".join(rng.choice("<|\\n\nx") for _ in range(rng.randint(0, 12))) for _ in range(3000)]:
        assert C.uncontrol(C.control(s)) == s and "<|" not in C.control(s)
        assert C.unname(C.name(s)) == s and "\n" not in C.name(s)


def brute(rows):
    out = {}
    probe = [(-1, 0, "user", C.PROBE), (-1, 1, "assistant", C.PROBE)]
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows} | {-1}:
        turns = [(r[2] or "", r[3] or "") for r in sorted([r for r in [*rows, *probe] if r[0] == conv], key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                     len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_matches_brute_force_and_reads_back(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb", "<|x"]), rng.choice(TRICKY))
            for c in [*range(30), None] for t in range(rng.randint(1, 7))]
    rows += [(5, 0, "assistant", "tie"), (5, 0, "assistant", "tie"), (5, None, "user", "no turn")] + [(99, i, "user", "hot") for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as part", "2 as n_turns")
    got = {r.conv_id: r for r in C.digest(C.with_probe(df)).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == brute(rows)
    pieces = C.format_conversations(df).filter("conv_id = 99").orderBy("part").collect()
    assert [p.part for p in pieces] == list(range(len(pieces)))
    reader = C.Reader()
    turns = [t for p in pieces for t in reader.feed(p.content, p.trained)]
    assert [t[:2] for t in turns] == [("user", "hot")] * 5000 and reader.chars == got[99].formatted_chars


@pytest.mark.parametrize("kind,want", [("string", ["-1", "a", "b"]), ("int", [-1, 1, 2]), ("decimal(5,1)", ["-1.0", "1.0", "2.0"])])
def test_ids_of_other_types(spark, kind, want):
    rows = [(i, t, "user", "x") for i in (1, 2) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    conv = F.when(F.col("conv_id") == 1, "a").otherwise("b") if kind == "string" else F.col("conv_id").cast(kind)
    df = df.withColumn("conv_id", conv).selectExpr("*", "1 as content", "2 as trained")
    got = C.digest(C.with_probe(df)).collect()
    assert sorted(r.conv_id for r in got) == want and {r.n_turns for r in got} == {2}
    assert {r.conv_id for r in C.format_conversations(df).collect()} == set(want[1:])


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.digest(none).count() == 0 and C.format_conversations(none).count() == 0
    assert [r.conv_id for r in C.digest(C.with_probe(none)).collect()] == [-1]


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    ok, why = compare(queries.op2_chat_template(spark, sf), C.ORACLE, duck(sf))
    assert ok, why
