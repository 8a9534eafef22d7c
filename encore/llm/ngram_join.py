"""Jaccard join of word n-gram sets by PartEnum signatures.

Sets of similar size share a size band: two sets that link (percent similarity
`similar`) are in one band or in neighbours, and differ in at most k shingles
for that band. The shingle domain is split, by hash, into enough partitions that
one of them has at most `spared` of those differences, and each partition again
into `parts`; every subset of `parts - spared` of these gives one signature, the
hash of the set's shingles in it. Linked sets therefore share a signature.
A set emits only as many partitions as its own size calls for, plus a few spare
ones; signatures of empty projections are left out when no more partitions than
the spare ones have any (a shared partition that is not empty then remains).
The largest sets (128 differences and more in PLAN_80) never emit empty or very
small projections, which unrelated texts with a common line share: of their 65
or more partitions about four in ten fit a pair that just links, and that none
of these is large enough has a chance below 1e-9, as little as digests collide.

Equal sets are one class, and classes are what is joined: 64-bit digests, of
which a task emits each once. In a bucket (one signature) every class is first
compared with the least class; what that links is one component. Pairs of
different components that share a bucket are then compared as well. Lossless
filters come first: sizes, and parity sketches, whose distance never exceeds the
difference of the sets (a short one inside the joins, then one with a bit or
more per shingle). What passes is decided by the exact intersection.

Cases: without words or text a set is empty and links with nothing; fewer than
`n` words are one shingle; rows with equal ids are rows of their own; a null id
counts only when no other is in the component; a very long text is a piece of its
own; empty tables give empty results. `near_duplicates` reads no other column,
`keep_one` keeps all of them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.llm.bytewords import LOWER, NOT_SPACE, Piece, mix, pieces, text_windows, window_hashes
from encore.llm.common import cut, free_name
from encore.llm.components import components
from encore.llm.sql import shingle_components

SKETCH = 8                                   # longs, of 64 parity bits each
#: Up to so many ids are broadcast to pick texts; beyond that they are joined by shuffle.
BROADCAST_IDS = 1_000_000
U = np.uint64


#: (differences below, parts, spared, partitions per spare one, least shingles of a projection). Small
#: sets are cut finer, as their partitions hold few shingles. Without spare ones (0), smaller
#: projections are never signatures; see the module's text.
Plan = tuple[tuple[int, int, int, int, int], ...]
ALL = 1 << 62
PLAN_80: Plan = ((40, 5, 2, 8, 1), (128, 3, 1, 8, 1), (256, 2, 1, 0, 2), (512, 2, 1, 0, 3), (ALL, 2, 1, 0, 4))
PLAN_90: Plan = ((ALL, 3, 1, 24, 1),)


class Bands:
    """Size bands from 1 on; band i ends at low[i] * 100 // similar."""

    def __init__(self, similar: int, most: int):
        self.t = similar
        low, high = [1], []
        while True:
            high.append(low[-1] * 100 // similar)
            if high[-1] > most * 2 + 2:
                break
            low.append(high[-1] + 1)
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, n)

    def difference(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Most elements in which linked sets of these sizes differ."""
        return (100 - self.t) * (a + b) // (100 + self.t)


def shingles(p: Piece, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each distinct shingle, in no order; set sizes."""
    words = p.hashes()
    count = np.diff(p.word_at)
    pos, h = text_windows(p, words, n)
    doc = p.doc[pos]
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        own = np.concatenate([window_hashes(words[p.word_at[i]:p.word_at[i + 1]], int(count[i])) for i in few])
        doc, h = np.concatenate([doc, few]), np.concatenate([h, own])
    key = mix(h + doc.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    doc, h = doc[order][first], h[order][first]
    return doc, h, np.bincount(doc, minlength=p.n)


def _sums(index: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """Sums modulo 2^64 of h by index; each half stays exact in a double."""
    lo = np.bincount(index, (h & U(0xFFFFFFFF)).astype(float), size).astype(U)
    hi = np.bincount(index, (h >> U(32)).astype(float), size).astype(U)
    return lo + (hi << U(32))


def classes(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Digest of each text's set."""
    return mix(_sums(doc, mix(h ^ U(0x5851F42D4C957F2D)), len(sizes)) + sizes.astype(U)).view(np.int64)


def sketches(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Parity of the number of shingles in each of SKETCH * 64 hash cells."""
    bits = SKETCH * 64
    cell = (mix(h ^ U(0x2545F4914F6CDD1D)) % U(bits)).astype(np.int64)
    odd = (np.bincount(doc * bits + cell, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def signatures(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray, similar: int,
               plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(text number, signature) of all texts with a set."""
    bands = Bands(similar, int(sizes.max(initial=1)))
    out_doc, out_sig = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for up in (0, 1):                        # as the band's own, and as partner of the next band
        j = bands.of(sizes) + up
        high = bands.high[j]
        partner = np.minimum(high, sizes * 100 // similar)
        joins = (sizes > 0) & ((partner >= bands.low[j]) if up else True)
        k, need = bands.difference(high, high), bands.difference(sizes, partner)
        seed = mix(j.astype(U) + U(0x632BE59BD9B4E019))
        below = 1
        # k = 0: only equal sets link, one signature of everything
        for limit, parts, spared, sparing, fewest in ((1, 1, 0, 0, 1), *plan):
            mine = joins & (k < limit) & (k >= below if limit > 1 else True)
            below = limit
            if not mine.any():
                continue
            base = k // (spared + 1) + 1
            spare = np.where(k > 0, 2 + base // (sparing or 24), 0)
            total = base + spare
            emit = np.where(mine, need // (spared + 1) + 1 + spare, 0)
            at = np.concatenate([[0], np.cumsum(emit)])
            n = int(at[-1])
            # partition of each shingle, then its part of the partition
            own = mine[doc]
            d, x = doc[own], h[own]
            r = mix(x ^ seed[d])
            part = ((r >> U(32)) * total[d].astype(U) >> U(32)).astype(np.int64)
            q = ((r & U(0xFFFFFFFF)) * U(parts) >> U(32)).astype(np.int64)
            use = part < emit[d]
            cell = (at[d[use]] + part[use]) * parts + q[use]
            sums = _sums(cell, mix(x[use]), n * parts).reshape(n, parts)
            filled = np.bincount(cell, minlength=n * parts).reshape(n, parts)
            owner = np.repeat(np.arange(len(sizes)), emit)
            tag = mix((np.arange(n) - at[owner]).astype(U) * U(0x9E3779B97F4A7C15) + seed[owner])
            subsets = [list(c) for c in combinations(range(parts), parts - spared)]
            some = np.column_stack([filled[:, c].sum(1) >= fewest for c in subsets])
            if limit > 1 and sparing:
                # texts with more partitions that have an empty projection than spare ones emit those too
                some |= (np.bincount(owner[~some.all(1)], minlength=len(sizes)) > spare)[owner][:, None]
            for i, c in enumerate(subsets):
                keep = some[:, i]
                out_doc.append(owner[keep])
                out_sig.append(mix(sums[keep][:, c].sum(1, dtype=U) + tag[keep] + U(i + 1)))
    return np.concatenate(out_doc), np.concatenate(out_sig).view(np.int64)


def fine_sketches(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Parity of the number of shingles in at least as many hash cells as there
    are shingles; a power of two, so that two sketches fold to the shorter."""
    bits = 512 << np.ceil(np.log2(np.maximum(sizes, 512) / 512)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(bits)])
    cell = at[doc] + (mix(h ^ U(0x14057B7EF767814F)) & (bits[doc] - 1).astype(U)).astype(np.int64)
    odd = (np.bincount(cell, minlength=at[-1]) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [
        None, pa.py_buffer((at // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd, bitorder="little"))])


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the difference of two sets, from their fine sketches."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _source(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def sets(df: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, cls (null without words), n_shingles and the sketches s0, s1, ...
    and fine (null in further copies of a class that a task reads)."""
    src = _source(df, doc_id, text)
    names = ["doc_id", "cls", "n_shingles", *(f"s{i}" for i in range(SKETCH)), "fine"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            for p in pieces(b.column(1), NOT_SPACE, LOWER):
                doc, h, size = shingles(p, n)
                cls, sk = classes(doc, h, size), sketches(doc, h, p.n)
                new = _first_seen(cls, size, done)
                fine = pc.if_else(pa.array(new), fine_sketches(doc, h, size), pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(p.first, p.n), pa.array(cls, mask=size == 0), pa.array(size.astype(np.int64)),
                     *(pa.array(np.ascontiguousarray(sk[:, i])) for i in range(SKETCH)), fine], names=names)

    return src.mapInArrow(run, T.StructType([
        T.StructField("doc_id", src.schema[0].dataType), *(T.StructField(c, T.LongType()) for c in names[1:-1]),
        T.StructField("fine", T.BinaryType())]))


def _first_seen(cls: np.ndarray, size: np.ndarray, done: set[int]) -> np.ndarray:
    new = np.zeros(len(cls), bool)
    for i, c in enumerate(cls.tolist()):
        if size[i] and c not in done:
            done.add(c)
            new[i] = True
    return new


def signature_rows(df: DataFrame, n: int, similar: int, plan: Plan, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(sig, cls); a task emits a class once, however many copies it reads."""
    src = _source(df, doc_id, text).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            for p in pieces(b.column(0), NOT_SPACE, LOWER):
                doc, h, size = shingles(p, n)
                cls = classes(doc, h, size)
                new = _first_seen(cls, size, done)
                at = new[doc]
                d, sig = signatures(doc[at], h[at], np.where(new, size, 0), similar, plan)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(cls[d])], names=["sig", "cls"])

    return src.mapInArrow(run, "sig long, cls long")


def _groups(rows: DataFrame) -> DataFrame:
    """(least, cls): the classes of all buckets that have one least class. Two
    classes of one bucket are in one group, and in few others."""
    own = Window.partitionBy("sig")
    return rows.withColumns({"least": F.min("cls").over(own), "top": F.max("cls").over(own)}) \
        .filter("least < top").select("least", "cls").distinct()


def _difference(similar: int, a: Column, b: Column) -> Column:
    return F.floor((a + b) * F.lit(100 - similar) / F.lit(100 + similar))


def _may_link(similar: int, a: str, b: str) -> Column:
    """Sizes and parity sketches allow a link; never false for a linked pair."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)), F.lit(0))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * similar) & (apart <= _difference(similar, na, nb))


def _verified(pairs: DataFrame, known: DataFrame, src: DataFrame, n: int, similar: int) -> DataFrame:
    """The pairs (u, v) of classes whose sets link, by exact intersection."""
    ends = pairs.select(F.col("u").alias("cls")).union(pairs.select("v")).distinct()
    ids = cut(known.join(ends, "cls").groupBy("cls").agg(F.min("doc_id").alias("pick"),
                                                          F.count("doc_id").alias("n_ids")))
    pick = ids.select("pick").distinct()
    if pick.count() <= BROADCAST_IDS:
        pick = F.broadcast(pick)
    texts = src.join(pick, src["doc_id"].eqNullSafe(pick["pick"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column(0), NOT_SPACE, LOWER):
                doc, h, size = shingles(p, n)
                cls = classes(doc, h, size)
                h = h[np.argsort(doc, kind="stable")]
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls, mask=size == 0), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))],
                    names=["cls", "members"])

    members = cut(texts.mapInArrow(run, "cls long, members array<long>").join(ends, "cls", "left_semi"))
    members = members.groupBy("cls").agg(F.first("members").alias("members"))
    both = pairs.join(members.select(F.col("cls").alias("u"), F.col("members").alias("a")), "u") \
        .join(members.select(F.col("cls").alias("v"), F.col("members").alias("b")), "v")
    same, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    return both.filter(same * 100 >= (total - same) * similar).select("u", "v")


def _finer(pairs: DataFrame, per: DataFrame, similar: int) -> DataFrame:
    """The pairs (u, v) whose fine sketches allow a link."""
    side = lambda c, f: per.select(F.col("cls").alias(c), F.struct("n_shingles", "fine").alias(f))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v") \
        .select("u", "v", "a.fine", "b.fine", _difference(similar, F.col("a.n_shingles"), F.col("b.n_shingles")).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [apart(x.as_buffer(), y.as_buffer()) <= d.as_py()
                  for x, y, d in zip(b.column(2), b.column(3), b.column(4), strict=True)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.toDF("u", "v", "a", "b", "most").mapInArrow(run, "u long, v long")


def link_classes(df: DataFrame, known: DataFrame, n: int, similar: int, plan: Plan, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(node, root) of linked classes; `known` are the cut sets of `df`."""
    src = _source(df, doc_id, text)
    per = known.filter("fine is not null").groupBy("cls").agg(*(F.first(c).alias(c) for c in known.columns[2:]))
    rough = per.drop("fine")
    groups = cut(_groups(signature_rows(df, n, similar, plan, doc_id, text)))
    a, b = rough.alias("a"), rough.alias("b")
    stars = groups.filter("cls <> least").select(F.col("cls").alias("u"), F.col("least").alias("v")) \
        .join(a, F.col("u") == F.col("a.cls")).join(b, F.col("v") == F.col("b.cls")) \
        .filter(_may_link(similar, "a", "b")).select("u", "v")
    stars = cut(_finer(stars, per, similar))
    # one partner each, the least that may link, joins most of what belongs together
    first = stars.groupBy("u").agg(F.min("v").alias("v"))
    links = cut(_verified(cut(first), known, src, n, similar))
    roots = components(links)

    def apart_still(pairs: DataFrame) -> DataFrame:
        r = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        return pairs.join(r("u"), "u", "left").join(r("v"), "v", "left") \
            .filter(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")

    others = cut(apart_still(stars.join(first, ["u", "v"], "left_anti")))
    if others.head(1):
        links = cut(links.union(_verified(others, known, src, n, similar)))
        roots = components(links)
    # groups that still hold more than one component
    placed = groups.join(roots, F.col("cls") == F.col("node"), "left") \
        .select("least", "cls", F.coalesce("root", "cls").alias("root"))
    mixed = placed.groupBy("least").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("least")
    open_ = cut(placed.join(mixed, "least").join(rough, "cls"))
    a, b = open_.alias("a"), open_.alias("b")
    cross = a.join(b, (F.col("a.least") == F.col("b.least")) & (F.col("a.cls") > F.col("b.cls"))
                   & (F.col("a.root") != F.col("b.root")) & _may_link(similar, "a", "b")) \
        .select(F.col("a.cls").alias("u"), F.col("b.cls").alias("v")).distinct().join(stars, ["u", "v"], "left_anti")
    cross = cut(_finer(cross, per, similar))
    if not cross.head(1):
        return roots
    return components(links.union(_verified(cross, known, src, n, similar)))


def _found(df: DataFrame, n: int, similar: int, plan: Plan, doc_id: str, text: str) -> DataFrame:
    """doc_id, cls, n_shingles, component_id and component_cls, the least class
    that has a row with the component's id; one row per input row."""
    known = cut(sets(df, n, doc_id, text))
    roots = link_classes(df, known, n, similar, plan, doc_id, text)
    per = known.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("own")) \
        .join(roots, F.col("cls") == F.col("node"), "left").select("cls", "own", F.coalesce("root", "cls").alias("root"))
    least = per.groupBy("root").agg(F.min(F.struct(F.isnull("own").alias("no_id"), "own", "cls")).alias("least"))
    named = per.join(least, "root").select("cls", F.col("least.own").alias("component_id"), F.col("least.cls").alias("component_cls"))
    return known.select("doc_id", "cls", "n_shingles").join(named, "cls", "left") \
        .select("doc_id", "cls", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id"))
                .otherwise(F.col("component_id")).alias("component_id"), "component_cls")


def near_duplicates(df: DataFrame, n: int = 5, similar: int = 80, plan: Plan = PLAN_80,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the least id reachable by links."""
    return _found(df, n, similar, plan, doc_id, text).select("doc_id", "n_shingles", "component_id")


def _with_class(df: DataFrame, name: str, n: int, text: str) -> DataFrame:
    """`df` and the digest of each text's set (null without words) as `name`."""
    where = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column(where).cast(pa.string()), NOT_SPACE, LOWER):
                doc, h, size = shingles(p, n)
                own = b.slice(p.first, p.n)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(classes(doc, h, size), mask=size == 0)],
                                                 names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(df: DataFrame, n: int = 5, similar: int = 80, plan: Plan = PLAN_80,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with one row of each component: one with its least id (null ids come
    last) and, of the sets that have that id, the least class. Where rows repeat
    both id and set, the one of the least text stays (then by a hash of the row, so
    that reruns agree); rows without words all stay."""
    found = cut(_found(df, n, similar, plan, doc_id, text))
    stays = F.col("cls").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("cls") == F.col("component_cls"))
    found = found.select("doc_id", "cls", stays.alias("stays"))
    ids = cut(found.groupBy("doc_id").agg(F.bool_or("stays").alias("any"), F.bool_and("stays").alias("all"),
                                          F.count_if(F.col("stays") & F.col("cls").isNotNull()).alias("times"))
              .filter("not all or times > 1"))
    name = free_name(df, "of_group")
    own = F.col(f"`{doc_id}`").eqNullSafe(F.col(name))

    def named(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows

    out = df.join(named(ids.filter("not any").select(F.col("doc_id").alias(name))), own, "left_anti")
    # ids of which some rows stay and others go: their rows are told apart by the class
    parted = ids.filter("any").select(F.col("doc_id").alias(name))
    if not parted.head(1):
        return out
    parted = named(parted)
    cls = free_name(df, "cls")
    rows = cut(_with_class(out.join(parted, own, "left_semi"), cls, n, text))
    left = found.filter("stays and cls is not null").distinct().select(F.col("doc_id").alias(name), F.col("cls").alias(f"{name}_cls"))
    kept = free_name(df, "kept_row")
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    once = rows.filter(F.col(cls).isNotNull()).groupBy(f"`{doc_id}`", cls) \
        .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(F.col(f"`{text}`"), F.xxhash64(*hashed))).alias(kept)) \
        .select(f"{kept}.*").join(left, own & (F.col(cls) == F.col(f"{name}_cls")), "left_semi")
    return out.join(parted, own, "left_anti").union(rows.filter(F.col(cls).isNull()).drop(cls)).union(once.drop(cls))


def oracle(n: int, similar: int) -> str:
    """DuckDB statement for `near_duplicates`, by exact similarities."""
    return f"{shingle_components(n, similar)}\nSELECT doc_id, n_shingles, component_id FROM linked"
