"""Benchmark decontamination with a generalised suffix automaton.

The automaton is over the words of all test items: one state per class of
equal end positions, with its longest length and suffix link. A document's
words are streamed through it, and at each word the state and the longest
matching length are known. Where that length reaches `window` words, or a whole
shorter item ends, the words matched are hit. Only runs of words that items
have at all are streamed.

Items come in rounds of at most about `ROUND_BYTES` of text, the size that is
broadcast. A worker keeps the hashes of a round's windows; which windows a batch of
documents holds tells the items that can occur in it, and only of these automata
are built, each of about `BLOCK_BYTES` and once a batch, and only documents with such a
window are streamed. So time follows the documents and what they share with the benchmark,
and a larger benchmark takes more rounds, not more memory; an item is never split.

Cases: null and empty texts have no words and no hits; items without words are
none; equal items all count, by their distinct ids (a null id is the empty
text); every row is scanned by itself, a very long text as a piece of its own; other
columns stay, and the struct's name gives way to theirs; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.llm.bytewords import ALNUM, LOWER, pieces, text_windows
from encore.llm.common import free_name

ROUND_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20


class Automaton:
    """Generalised suffix automaton over lists of word numbers."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.next)
        self.whole: list[tuple[tuple[int, str], ...]] = [()] * n      # short items that are this state's word sequence
        own: list[set[str]] = [set() for _ in range(n)]
        for name, words in items:
            state = 0
            for w in words:
                state = self.next[state][w]
                own[state].add(name)
            if 0 < len(words) < window:
                self.whole[state] += ((len(words), name),)
        by_length = sorted(range(n), key=self.length.__getitem__)
        # an item ends wherever a longer sequence with this suffix ends
        for s in reversed(by_length[1:]):
            if self.length[self.link[s]] >= window:
                own[self.link[s]] |= own[s]
        self.top, self.items = [0] * n, own
        for s in by_length[1:]:
            up = self.link[s]
            self.top[s] = self.top[up] if self.length[up] >= window else s
            self.whole[s] += self.whole[up]

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state that p reaches by w, made to hold no longer sequences."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        half = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = half
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = half
            p = self.link[p]
        return half

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (end exclusive) and the items that occur."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = n = 0
        spans, names, tops = [], set(), set()
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            else:
                state = n = 0
            if n >= window:
                spans.append((i + 1 - n, i + 1))
                tops.add(self.top[state])
            for size, name in self.whole[state]:
                if size <= n:
                    spans.append((i + 1 - size, i + 1))
                    names.add(name)
        for t in tops:
            names |= self.items[t]
        return spans, names


def _words(texts: list[str]) -> list[np.ndarray]:
    out = []
    for p in pieces(pa.array(texts, pa.large_string()), ALNUM, LOWER):
        out += np.split(p.hashes(), p.word_at[1:-1])
    return out


class Block:
    """An automaton and the sorted hashes of its words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = _words([t for _, t in items])
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        ids = [(name, np.searchsorted(self.vocabulary, w).tolist()) for (name, _), w in zip(items, words, strict=True)]
        self.least = min([window, *(len(w) for _, w in ids if w)])
        self.automaton = Automaton(ids, window)

    def scan(self, hashes: np.ndarray, doc: np.ndarray, hit: np.ndarray, names: list[set[str]]) -> None:
        """Marks the hit words of a piece and adds item names by text."""
        if not len(self.vocabulary) or not len(hashes):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        begins = known.copy()
        begins[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
        stops = np.append(known[:-1] & (~known[1:] | (doc[1:] != doc[:-1])), known[-1])
        first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        long_ = last - first >= self.least
        for a, b in zip(first[long_].tolist(), last[long_].tolist(), strict=True):
            spans, found = self.automaton.stream(at[a:b].tolist())
            for x, y in spans:
                hit[a + x:a + y] = True
            if found:
                names[doc[a]] |= found


class Index:
    """Hashes of the windows of a round's items, and which item each is of."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.items, self.window = items, window
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for p in pieces(pa.array([t for _, t in items], pa.large_string()), ALNUM, LOWER):
            hashes, size = p.hashes(), np.minimum(np.diff(p.word_at), window)
            for k in np.unique(size[size > 0]).tolist():
                pos, h = text_windows(p, hashes, k)
                item = p.doc[pos]
                own = size[item] == k
                found.setdefault(k, []).append((h[own], p.first + item[own]))
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, parts in found.items():
            h, item = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
            order = np.argsort(h, kind="stable")
            self.windows[k] = h[order], item[order]

    def candidates(self, p, hashes: np.ndarray) -> tuple[set[int], set[int]]:
        """Texts of a piece that hold a window, and items that have one of these."""
        texts, items = set(), set()
        for k, (known, item) in self.windows.items():
            pos, h = text_windows(p, hashes, k)
            first = np.searchsorted(known, h)
            hit = np.flatnonzero(known[np.minimum(first, len(known) - 1)] == h)
            if len(hit):
                texts.update(p.doc[pos[hit]].tolist())
                low, at = np.unique(first[hit], return_index=True)
                for a, z in zip(low, np.searchsorted(known, h[hit][at], "right"), strict=True):
                    items.update(item[a:z].tolist())
        return texts, items


_index: dict = {}


def _index_of(key: tuple, items: list[tuple[str, str]], window: int) -> Index:
    """A worker keeps the last round's."""
    if key not in _index:
        _index.clear()
        _index[key] = Index(items, window)
    return _index[key]


def hits_of(texts: pa.Array, index: Index, before: list[dict] | None = None) -> list[dict]:
    """For each text its words, hit words, items and hit spans; with those of earlier rounds."""
    rows: list[dict] = []
    hashes, spans, owners, needed = [], [], [], set()
    for p in pieces(texts, ALNUM, LOWER):
        own = p.hashes()
        some, items = index.candidates(p, own)
        needed |= items
        for i, n in enumerate(np.diff(p.word_at).tolist()):
            rows.append({"n_words": n, "n_hit": 0, "items": [], "bytes": []} if before is None else before[p.first + i])
        for i in sorted(some):
            words = slice(p.word_at[i], p.word_at[i + 1])
            owners.append(p.first + i)
            hashes.append(own[words])
            spans.append(np.column_stack([p.starts[words], p.ends[words]]) - p.at[i])
    if not owners:
        return rows
    size = [len(h) for h in hashes]
    all_, doc = np.concatenate(hashes), np.repeat(np.arange(len(size)), size)
    hit, names = np.zeros(len(all_), bool), [set() for _ in size]
    for block in _split_blocks([index.items[i] for i in sorted(needed)]):
        Block(block, index.window).scan(all_, doc, hit, names)
    at = 0
    for i, n, where, found in zip(owners, size, spans, names, strict=True):
        own, old = hit[at:at + n], rows[i]
        at += n
        for a, z in zip(old["bytes"][::2], old["bytes"][1::2], strict=True):
            own |= (where[:, 0] >= a) & (where[:, 1] <= z)
        first, last = _runs(own)
        flat = np.column_stack([where[first, 0], where[last - 1, 1]]).ravel().tolist() if len(first) else []
        rows[i] = {"n_words": n, "n_hit": int(own.sum()), "items": sorted(found | set(old["items"])), "bytes": flat}
    return rows


def _rounds(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """Items of each round, and whether it is the last; which round an item is
    in follows from its hash."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"),
                             F.col(text).cast("string").alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    rounds = 1 + int(size // ROUND_BYTES)
    for r in range(rounds):
        part = items if rounds == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(rounds)) == r)
        yield sorted((x[0], x[1]) for x in part.collect()), r == rounds - 1


def _split_blocks(items: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    out, size = [[]], 0
    for x in items:
        if size > BLOCK_BYTES:
            out.append([])
            size = 0
        out[-1].append(x)
        size += len(x[1])
    return out


HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                     T.StructField("items", T.ArrayType(T.StringType())),
                     T.StructField("bytes", T.ArrayType(T.LongType()))])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                    ("bytes", pa.list_(pa.int64()))])


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def scan(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = 10, finish=None) -> DataFrame:
    """All columns of `df`, and last a struct (named hits, or _hits...): n_words,
    n_hit, items (sorted ids), bytes (start, end of each hit span in the text's
    UTF-8, flat). `finish`, if given, makes of each batch with its hits one with
    the columns of `df`, in the last round's pass."""
    name = free_name(df, "hits")
    kept = df.schema
    where, sc = df.columns.index(text), df.sparkSession.sparkContext
    rounds = _rounds(benchmark, item_id, item_text)
    for k, (items, last_round) in enumerate(rounds):
        final = finish if last_round else None
        held = sc.broadcast(items)
        key = held.id if hasattr(held, "id") else id(held)
        earlier = k > 0

        def run(batches: Iterator[pa.RecordBatch], held=held, key=(key, k), earlier=earlier, final=final) -> Iterator[pa.RecordBatch]:
            index = _index_of((*key, window), held.value, window)
            for b in batches:
                before = b.column(len(b.schema) - 1).to_pylist() if earlier else None
                rows = hits_of(b.column(where), index, before)
                new = pa.array(rows, _ARROW)
                if earlier:
                    b = b.set_column(len(b.schema) - 1, b.schema.field(len(b.schema) - 1), new)
                else:
                    b = pa.RecordBatch.from_arrays([*b.columns, new], names=[*b.schema.names, name])
                yield final(b) if final else b

        df = df.mapInArrow(run, kept if final else T.StructType([*kept.fields, T.StructField(name, HITS)]))
    return df


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", max_coverage: float = 0.8, **params) -> DataFrame:
    """`df` with the hit spans cut out of its texts. A row is dropped when more
    than `max_coverage` of its words are hit."""
    where = df.columns.index(text)

    def cut_out(b: pa.RecordBatch) -> pa.RecordBatch:
        hits = b.column(len(b.schema) - 1)
        n = hits.field(1).to_numpy(zero_copy_only=False)
        if n.any():
            texts = b.column(where).to_pylist()
            for i in np.flatnonzero(n):
                raw, flat = texts[i].encode(), hits[int(i)]["bytes"].as_py()
                keep = zip([0, *flat[1::2]], [*flat[::2], len(raw)], strict=True)
                texts[i] = b"".join(raw[a:z] for a, z in keep).decode()
            b = b.set_column(where, b.schema.field(where), pa.array(texts, b.column(where).type))
        share = n / np.maximum(hits.field(0).to_numpy(zero_copy_only=False), 1)
        return b.filter(pa.array(share <= max_coverage)).select(range(len(b.schema) - 1))

    return scan(df, benchmark, text, finish=cut_out, **params)


def digest(marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    h = F.col(marked.columns[-1])
    return marked.select(F.col(doc_id).alias("doc_id"), h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"),
                         F.size(h["items"]).cast("long").alias("n_items"),
                         F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"),
                         (h["n_hit"] > 0).alias("contaminated"))


_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, COALESCE(regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT COALESCE(CAST(item_id AS VARCHAR), '') AS item,
             COALESCE(regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item, k, i FROM dw JOIN iw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
      FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(names, '')) AS items_sha256,
       COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
