"""Near duplicates by b-bit MinHash.

A set's signature is the least of `SLOTS` hashes of its shingles. Bands, hashes of
`WIDTH` minima each, are keys; sets that share a key are candidates. Then only the
low BITS bits of each minimum are retained, in BITS packed bit planes, and the
similarity of two sets is estimated by counting equal slots: of a share e of
equal slots, c = 2^-BITS collide by chance, so (e - c) / (1 - c) is the estimate.
Candidates whose estimate a linked pair has with a chance below `CHANCE` are
left out. The exact check of the others begins with what bounds it (sizes, and the
parity of shingle counts in hash cells, whose distance never exceeds the difference
of the sets) and ends with the intersection of the full sets.

Bands come from two random orders of the slots, so a pair that just links (0.85)
shares none with a chance of about 1e-10, and a pair of similarity 0.3 shares one
of them in 60 times. So the loss of a link is as unlikely as digests colliding, but
not impossible; sizes out of proportion are left out for certain.

Equal sets are one class (a 64-bit digest) and classes are what is joined. In a
bucket every class is compared with the least one, buckets with one least class
counting as one; pairs of classes of different components that share a bucket
are compared as well, the smaller components of a bucket with all of it, a large
bucket in parts of `PART` classes.

Cases: without words or text a set is empty and links with nothing; fewer than `n`
words are one shingle; a very long text is a piece of its own; rows with equal ids
are rows of their own, and all of them are kept where their id is the least; a null
id counts only when no other is in the component; empty tables give empty results;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.llm.bytewords import LOWER, NOT_SPACE, mix, pieces
from encore.llm.common import cut
from encore.llm.components import components
from encore.llm.ngram_join import SKETCH, classes, shingles, sketches
from encore.llm.sql import shingle_components

SLOTS, BITS, WIDTH, ORDERS = 256, 2, 7, 2
CHANCE = 1e-9
#: A mixed bucket is dealt to parts of about so many classes.
PART = 1024
#: Up to so many ids are broadcast to pick texts; beyond that they are joined by shuffle.
BROADCAST_IDS = 1_000_000
U = np.uint64
_FACTOR = mix(np.arange(1, SLOTS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_ADD = mix(np.arange(1, SLOTS + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))


def _bands() -> np.ndarray:
    """Slots of each band: a random order cut into bands, ORDERS times."""
    rng = np.random.default_rng(12)
    each = SLOTS // WIDTH
    return np.concatenate([rng.permutation(SLOTS)[:each * WIDTH].reshape(each, WIDTH) for _ in range(ORDERS)])


BANDS = _bands()
PLANES = BITS * SLOTS // 64                  # longs of a packed signature
_OF_PLANE = SLOTS // 64


def minima(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(SLOTS, texts with a set): the least hash of each slot, 47 bits."""
    order = np.argsort(doc, kind="stable")
    h = h[order]
    some = sizes > 0
    at = (np.cumsum(sizes) - sizes)[some]
    out = np.zeros((SLOTS, len(at)), U)
    if len(at):
        for i in range(SLOTS):
            np.minimum.reduceat(h * _FACTOR[i] + _ADD[i], at, out=out[i])
    return out >> U(17)


def band_keys(least: np.ndarray) -> np.ndarray:
    """(texts, bands): a hash of each band's minima and its number."""
    out = np.zeros((least.shape[1], len(BANDS)), U)
    for i, slots in enumerate(BANDS):
        h = np.full(least.shape[1], _FACTOR[i])
        for s in slots:
            h = mix(h * U(0xD1342543DE82EF95) + least[s])
        out[:, i] = h
    return out.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """(texts, PLANES): plane by plane, bit j of the minima of all slots."""
    planes = [np.packbits(((least >> U(j)) & U(1)).astype(np.uint8).T, axis=1, bitorder="little") for j in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def least_equal(similar: int, slots: int = SLOTS, chance: float = CHANCE) -> int:
    """The fewest equal slots of a pair that just links, but for `chance`."""
    c = 2.0 ** -BITS
    p = similar / 100 * (1 - c) + c
    total = 0.0
    for k in range(slots + 1):
        total += comb(slots, k) * p ** k * (1 - p) ** (slots - k)
        if total > chance:
            return k
    return slots


def equal_slots(a: str, b: str) -> Column:
    """Number of slots whose retained bits agree."""
    differ = []
    for k in range(_OF_PLANE):
        planes = [F.col(f"{a}.b{j * _OF_PLANE + k}").bitwiseXOR(F.col(f"{b}.b{j * _OF_PLANE + k}")) for j in range(BITS)]
        word = planes[0]
        for plane in planes[1:]:
            word = word.bitwiseOR(plane)
        differ.append(F.bit_count(word))
    return F.lit(SLOTS) - sum(differ[1:], differ[0])


def estimate(a: str, b: str) -> Column:
    """Similarity corrected for slots that agree by chance."""
    c = 2.0 ** -BITS
    return (equal_slots(a, b) / F.lit(SLOTS) - c) / (1 - c)


_SIGNATURE = [f"b{i}" for i in range(PLANES)]
_PARITY = [f"s{i}" for i in range(SKETCH)]


def may_link(similar: int, a: str = "a", b: str = "b") -> Column:
    """The estimate, the sizes and the parities of two sets allow a link."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    differ = [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _PARITY]
    most = F.floor((na + nb) * F.lit(100 - similar) / F.lit(100 + similar))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * similar) & (equal_slots(a, b) >= least_equal(similar)) \
        & (sum(differ[1:], differ[0]) <= most)


def signatures(df: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, cls (null without words), n_shingles, the packed signature, parities
    and the band keys (null in further copies of a class that a task reads)."""
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    names = ["doc_id", "cls", "n_shingles", *_SIGNATURE, *_PARITY, "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            for p in pieces(b.column(1), NOT_SPACE, LOWER):
                doc, h, size = shingles(p, n)
                cls = classes(doc, h, size)
                new = np.zeros(p.n, bool)
                for i, c in enumerate(cls.tolist()):
                    if size[i] and c not in done:
                        done.add(c)
                        new[i] = True
                at = new[doc]
                own = np.where(new, size, 0)
                least = minima(doc[at], h[at], own)
                where = np.cumsum(new) - 1                       # column of a new text
                sig = packed(least)[where] if least.shape[1] else np.zeros((p.n, PLANES), np.int64)
                keys, odd = band_keys(least), sketches(doc, h, p.n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new) * len(BANDS)]).astype(np.int32)),
                                                 pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(p.first, p.n), pa.array(cls, mask=size == 0), pa.array(size.astype(np.int64)),
                     *(pa.array(np.ascontiguousarray(sig[:, i]), mask=~new) for i in range(PLANES)),
                     *(pa.array(np.ascontiguousarray(odd[:, i]), mask=~new) for i in range(SKETCH)),
                     pc.if_else(pa.array(new), lists, pa.scalar(None, lists.type))], names=names)

    return src.mapInArrow(run, T.StructType([
        T.StructField("doc_id", src.schema[0].dataType), *(T.StructField(c, T.LongType()) for c in names[1:-1]),
        T.StructField("bands", T.ArrayType(T.LongType()))]))


def _groups(bands: DataFrame) -> DataFrame:
    """(least, cls) of all buckets of two and more classes, by their least class."""
    keys = bands.select("cls", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("cls").alias("least"), F.max("cls").alias("top")).filter("least < top")
    return keys.join(shared.select("key", "least"), "key").select("least", "cls").distinct()


def _exact(pairs: DataFrame, per: DataFrame, df: DataFrame, n: int, similar: int, doc_id: str, text: str) -> DataFrame:
    """The pairs (u, v) of classes whose full sets link."""
    ends = pairs.select(F.col("u").alias("cls")).union(pairs.select("v")).distinct()
    pick = cut(per.join(ends, "cls", "left_semi").select(F.col("own").alias("pick")).distinct())
    if pick.count() <= BROADCAST_IDS:
        pick = F.broadcast(pick)
    texts = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    texts = texts.join(pick, texts["doc_id"].eqNullSafe(pick["pick"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column(0), NOT_SPACE, LOWER):
                doc, h, size = shingles(p, n)
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                members = pa.ListArray.from_arrays(pa.array(at), pa.array(h[np.argsort(doc, kind="stable")].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(classes(doc, h, size), mask=size == 0), members], names=["cls", "members"])

    members = cut(texts.mapInArrow(run, "cls long, members array<long>").join(ends, "cls", "left_semi"))
    members = members.groupBy("cls").agg(F.first("members").alias("members"))
    side = lambda c, m: members.select(F.col("cls").alias(c), F.col("members").alias(m))
    same = F.size(F.array_intersect("a", "b"))
    total = F.size("a") + F.size("b") - same
    return pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").filter(same * 100 >= total * similar).select("u", "v")


def per_class(known: DataFrame) -> DataFrame:
    """One row per class: its least id, size, signature and parities. Copies meet
    in partial aggregates first."""
    kept = ["n_shingles", *_SIGNATURE, *_PARITY]
    return known.filter("cls is not null").groupBy("cls") \
        .agg(F.min("doc_id").alias("own"), *(F.first(c, ignorenulls=True).alias(c) for c in kept))


def link_classes(df: DataFrame, known: DataFrame, per: DataFrame, n: int, similar: int, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(node, root) of linked classes; `known` and `per` are the cut signatures of
    `df` and of its classes."""
    # sets of so few shingles only link with equal ones
    fewest = similar // (100 - similar)
    groups = cut(_groups(known.filter("bands is not null").filter(F.col("n_shingles") >= fewest).select("cls", "bands")))
    may = may_link(similar)
    a, b = per.alias("a"), per.alias("b")
    stars = cut(groups.filter("cls <> least").select(F.col("cls").alias("u"), F.col("least").alias("v"))
                .join(a, F.col("u") == F.col("a.cls")).join(b, F.col("v") == F.col("b.cls")).filter(may).select("u", "v"))
    check = lambda pairs: _exact(cut(pairs), per, df, n, similar, doc_id, text)
    # one partner each, the least that may link, joins most of what belongs together
    one = stars.groupBy("u").agg(F.min("v").alias("v"))
    links = cut(check(one))
    roots = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        r = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        return pairs.join(r("u"), "u", "left").join(r("v"), "v", "left") \
            .filter(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")

    others = cut(apart(stars.join(one, ["u", "v"], "left_anti")))
    if others.head(1):
        links = cut(links.union(check(others)))
        roots = components(links)
    # buckets that still hold more than one component
    placed = groups.join(roots, F.col("cls") == F.col("node"), "left").select("least", "cls", F.coalesce("root", "cls").alias("root"))
    sizes = placed.groupBy("least", "root").agg(F.count("*").alias("n"))
    main = cut(sizes.groupBy("least").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("n"))
               .filter("roots > 1").select("least", F.col("main.root").alias("main"), F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    placed = cut(placed.join(main, "least")).join(per.drop("own"), "cls")
    minor = placed.filter("root <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = placed.withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    a, b = minor.alias("a"), every.alias("b")
    either = (F.col("b.root") == F.col("b.main")) | (F.col("a.cls") > F.col("b.cls"))
    cross = a.join(b, (F.col("a.least") == F.col("b.least")) & (F.col("a.salt") == F.col("b.salt"))
                   & (F.col("a.root") != F.col("b.root")) & either & may) \
        .select(F.greatest("a.cls", "b.cls").alias("u"), F.least("a.cls", "b.cls").alias("v")).distinct() \
        .join(stars, ["u", "v"], "left_anti")
    cross = cut(cross)
    if not cross.head(1):
        return roots
    return components(links.union(_exact(cross, per, df, n, similar, doc_id, text)))


def near_duplicates(df: DataFrame, n: int = 5, similar: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links) and kept
    (the id is the component's own); one row per input row."""
    known = cut(signatures(df, n, doc_id, text))
    per = cut(per_class(known))
    roots = link_classes(df, known, per, n, similar, doc_id, text)
    per = per.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "own", F.coalesce("root", "cls").alias("root"))
    least = per.groupBy("root").agg(F.min("own").alias("component_id"))
    named = per.join(least, "root").select("cls", "component_id")
    out = known.select("doc_id", "cls", "n_shingles").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def oracle(n: int, similar: int) -> str:
    return shingle_components(n, similar) + "\nSELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM linked\n"
