"""Personal data: regular expressions propose spans, checksum validators confirm
them, and context words near a span move its score.

Kinds: email, ip, card, phone (a base set that always stays) and the method's
own: cards inside longer digit runs, phones inside longer runs or without a
plus sign, iban (mod 97) and ssn. A proposal with score 0.5 or more is a span;
the base set has a score as well. Offsets count code points, end exclusive.

Cases: a null or empty text has no spans; spans that overlap all count (`mask` makes
one of them, named after the best scored, the first of equals); every row is handled by
itself, so repeated rows give equal results and empty tables empty ones. All scans are
linear in the text, whatever its length. `redact` keeps every column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]
SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a digit run can only begin a match at its first digit
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]++")
_PART = re.compile(r"[^\x20]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_WORD = re.compile(r"[^\W\d_]+")

CONTEXT = {
    "email": {"email", "mail", "contact"}, "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "carte", "karte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "telefon", "handy"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security"},
}
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GE": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29,
}
NEAR = 40                                    # characters on either side


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * 10 + ord(c) - 48 if c.isdigit() else rest * 100 + ord(c) - 55) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: what stands before an @ is a run of local-part
    characters, from the last match on, so each @ is looked at once."""
    end, at, floor = 0, text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        floor = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(s: str) -> str:
    return "".join(_RUN.findall(s))


def _near(text: str, start: int, end: int, kind: str) -> bool:
    around = text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]
    return any(w.lower() in CONTEXT[kind] for w in _WORD.findall(around))


def _cards_inside(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Cards in a run of digit groups that is none as a whole: four groups of
    four, or one group of 16 to 19 digits."""
    groups = [m.span() for m in _RUN.finditer(text, start, end)]
    i = 0
    while i < len(groups):
        a, b = groups[i]
        if 16 <= b - a <= 19 and luhn(text[a:b]):
            yield a, b
        elif b - a == 4 and all(y - x == 4 for x, y in groups[i:i + 4]) and len(groups[i:i + 4]) == 4 \
                and luhn(_digits(text[a:groups[i + 3][1]])):
            yield a, groups[i + 3][1]
            i += 3
        i += 1


def _phones_inside(text: str, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    """Phones in a whole run of digits that is too long for one: its parts between
    spaces, joined to stretches of 8 to 15 digits so that most digits are in one and, of
    such divisions, lengths are nearest to 11. True for the first and for those whose groups of
    digits are like the first's (without its country code) or 3-3-4. An IP address
    divides the run."""
    parts = [(start + m.start(), start + m.end()) for m in _PART.finditer(text[start:end])]
    size = [0 if _IP.fullmatch(text, a, b) and all(map(_small, text[a:b].split("."))) else len(_digits(text[a:b])) for a, b in parts]
    # best[i]: most digits in phones from part i on, least penalty, where the phone from i ends (i: none does)
    best: list[tuple[int, int, int]] = [(0, 0, 0)] * (len(parts) + 1)
    for i in range(len(parts) - 1, -1, -1):
        best[i] = (*best[i + 1][:2], i)
        n = 0
        for j in range(i, len(parts)):
            n += size[j]
            if not size[j] or n > 15:
                break
            if n >= 8 and text[parts[j][1] - 1].isdigit():
                best[i] = max(best[i], (best[j + 1][0] + n, best[j + 1][1] - (n - 11) ** 2, j + 1))
    i, shapes = 0, [[3, 3, 4]]
    while i < len(parts):
        j = best[i][2]
        if j > i:
            shape = [len(g) for g in _RUN.findall(text, parts[i][0], parts[j - 1][1])]
            if not i:
                shapes += [shape, shape[1:]]
            yield parts[i][0], parts[j - 1][1], shape in shapes
        i = max(j, i + 1)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Runs that hold mod 97 as they are or, where a word follows in capitals, up to a
    space before it: at the country's length, or the longest such part."""
    m = _IBAN.search(text)
    while m:
        a, b = m.span()
        ends = [b, *(i for i in range(b - 1, a, -1) if text[i] == " ")]
        most = IBAN_LENGTHS.get(text[a:a + 2])
        for end in ends:
            s = text[a:end].replace(" ", "")
            if 15 <= len(s) <= 34 and (end == b or most in (None, len(s))) and mod97(s):
                yield a, end
                break
        else:
            end = next((i for i in range(a, b) if text[i] == " "), b)    # the next may begin inside
        m = _IBAN.search(text, end)


def find(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind as in KINDS, then by start."""
    if not text:
        return []
    out: dict[str, list] = {k: [] for k in KINDS}

    def put(kind, start, end, score, base):
        score = min(1.0, score + (0.3 if _near(text, start, end, kind) else 0.0))
        if base or score >= 0.5:
            out[kind].append((kind, start, end, score, base))

    if "@" in text:
        for a, b in _emails(text):
            put("email", a, b, 0.9, True)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m.group().split("."))):
                put("ip", m.start(), m.end(), 0.6, True)
        for m in _CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                put("card", m.start(), m.end(), 0.8, True)
            elif 13 <= len(d) <= 15 and luhn(d):
                put("card", m.start(), m.end(), 0.3, False)
            elif len(d) > 16:
                for a, b in _cards_inside(text, m.start(), m.end()):
                    put("card", a, b, 0.6, False)
        if "+" in text:
            for m in _PHONE.finditer(text):
                n = len(_digits(m.group()))
                if 8 <= n <= 15:
                    put("phone", m.start(), m.end(), 0.7, True)
                elif n > 15:
                    for a, b, like in _phones_inside(text, *m.span()):
                        put("phone", a, b, 0.6 if like else 0.3, False)
        for m in _LOCAL_PHONE.finditer(text):
            if not any(a < m.end() and m.start() < b for _, a, b, *_ in out["phone"]):
                put("phone", m.start(), m.end(), 0.3, False)
        out["phone"].sort(key=lambda s: s[1])
        for a, b in _ibans(text):
            put("iban", a, b, 0.8, False)
        for m in _SSN.finditer(text):
            if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                put("ssn", m.start(), m.end(), 0.4, False)
    return [s for k in KINDS for s in out[k]]


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that
    overlap become one, named after the best scored of them."""
    spans = sorted(find(text), key=lambda s: s[1])
    if not spans:
        return text
    parts, at, i = [], 0, 0
    while i < len(spans):
        kind, a, b, score, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            if spans[i][3] > score:
                kind, score = spans[i][0], spans[i][3]
            b = max(b, spans[i][2])
            i += 1
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its spans, one row per input row."""
    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "score", "base")
        for b in batches:
            found = [[dict(zip(names, s, strict=True)) for s in find(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return src.mapInArrow(run, T.StructType([T.StructField("doc_id", src.schema[0].dataType),
                                             T.StructField("spans", SPAN)]))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with masked texts; all other columns as they were."""
    where = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(where)
            yield b.set_column(where, b.schema.field(where),
                               pa.array([mask(t.as_py()) for t in col], col.type))

    return df.mapInArrow(run, df.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    named = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
                        F.sha2(F.array_join(F.transform(base, named), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", named), ",").alias("spans"))
