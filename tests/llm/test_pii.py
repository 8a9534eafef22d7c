import hashlib
import random
import re

from encore.llm import pii
from tests.llm.helpers import ODD_TEXTS, documents

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        odd = [int(c) for c in d[::-1]]
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(odd)) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def card(rng):
    d = [rng.randint(0, 9) for _ in range(15)]
    return next(s for c in range(10) if valid("card", s := "".join(map(str, d + [c]))))


def texts():
    rng = random.Random(5)
    out = list(ODD_TEXTS)
    for _ in range(3000):
        out.append("".join(rng.choice("a.@%-+0123 ()9é\n2.5@b") for _ in range(rng.randint(1, 60))))
    for _ in range(300):
        n = lambda: rng.randint(0, 300)
        out.append(" ".join(rng.choice([f"{n()}.{n()}.{n()}.{n()}", card(rng), "é", "x.y+z@mail.example.com",
                                        "+1 (017) 555-7713", "call", "word", "+44 20 7946 0958",
                                        "-".join(re.findall("....", card(rng)))]) for _ in range(12)))
    return out + ["1" * 5000, "1." * 5000, "a@" * 3000, "a" * 20000 + "@b.c", "+1" + " " * 20000]


def test_base_spans_match_the_plain_patterns():
    for t in texts():
        found = pii.find(t)
        assert [s[:3] for s in found if s[4]] == brute(t), t[:200]
        assert found == sorted(found, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_validators_and_context():
    kinds = lambda t: [(k, t[a:b]) for k, a, b, _, base in pii.find(t) if not base]
    assert kinds("iban GB82 WEST 1234 5698 7654 32.") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("GB83 WEST 1234 5698 7654 32") == []
    assert kinds("social security 123-45-6789") == [("ssn", "123-45-6789")] and kinds("123-45-6789") == []
    assert kinds("call 555-123-4567 now") == [("phone", "555-123-4567")] and kinds("x 555-123-4567") == []
    assert kinds("4111111111111111 4111111111111111") == [("card", "4111111111111111")] * 2
    assert kinds("+1 (843) 555-7672 170.106.47.218 x") == [("phone", "+1 (843) 555-7672")]


def test_whole_runs_of_phones_are_walked():
    phones = lambda t: [t[a:b] for k, a, b, *_ in pii.find(t) if k == "phone"]
    run = "+1 202 555 0143 202 555 0199 303 555 0112"
    assert phones(run) == ["+1 202 555 0143", "202 555 0199", "303 555 0112"]
    many = "+1 202 555 0143" + " 202 555 0199" * 500
    assert len(phones(many)) == 501 and pii.mask(many) == " ".join(["[PHONE]"] * 501)
    assert phones("+44 20 7946 0958 20 7946 0959 20 7946 0960") == ["+44 20 7946 0958", "20 7946 0959", "20 7946 0960"]
    # eight digits that are not like the first are left, unless a word near them says phone
    assert phones("+1 202 555 0143 202 555 0199 12345678 units") == ["+1 202 555 0143", "202 555 0199"]
    assert phones("+1 (843) 555-7672 170.106.47.218 202 555 0199") == ["+1 (843) 555-7672", "202 555 0199"]


def test_ibans_before_words_in_capitals():
    ibans = lambda t: [t[a:b] for k, a, b, *_ in pii.find(t) if k == "iban"]
    es, gb = "ES91 2100 0418 4502 0005 1332", "GB82 WEST 1234 5698 7654 32"
    for tail in ("", " EUR", " PAID", " EUR PAID SOON", ".", " AND 12", f" {gb}"):
        assert es in ibans(f"to {es}{tail}"), tail
    assert ibans(f"{es} {gb} EUR") == [es, gb] and ibans(f"{gb}") == [gb]
    assert ibans("ES91 2100 0418 4502 0005 1333 EUR") == []
    assert pii.mask(f"to {es} EUR") == "to [IBAN] EUR"


def test_mask():
    assert pii.mask("mail a.b@c.de and 1.2.3.4") == "mail [EMAIL] and [IP]"
    assert pii.mask("1.2.3.4@x.org") == "[EMAIL]"
    assert pii.mask(None) is None and pii.mask("") == "" and pii.mask("nothing") == "nothing"


def test_query_columns(spark):
    ts = texts()[:200]
    rows = {r.doc_id: r for r in pii.digest(pii.spans(documents(spark, ts))).collect()}
    for i, t in enumerate(ts):
        want = brute(t)
        assert [rows[i][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert rows[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in pii.find(t))


def test_redact_keeps_columns(spark):
    docs = documents(spark, ["x a@b.co", None, "x a@b.co"]).selectExpr("*", "1 as spans", "'k' as kind")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert [r.text for r in got.orderBy("doc_id").collect()] == ["x [EMAIL]", None, "x [EMAIL]"]
    assert pii.redact(docs.limit(0)).count() == 0
