"""Texts that resemble each other, by SimHash over five-word shingles and multi-index hashing.

Two texts are linked when the Jaccard similarity of their sets of five-word
shingles is ``RESEMBLANCE`` at least, which is checked exactly. Pairs to check
come from fingerprints of ``BITS`` bits: the majority over the hashes of the
different shingles. Fingerprints of sets at similarity 0.8 differ in 15 of 100
bits. A fingerprint is cut into ``SEGMENTS`` segments; a text is stored under each
and looks up the ball of radius 1 around each, and what meets is compared over
the whole fingerprint (``RADIUS``). A pair at 0.8 is met with a chance of 0.92, at
0.85 of 0.98, at 0.9 of 0.998. Wider corpora want wider segments: what a text meets by
chance is the number of texts over 2 ** (bits of a segment).

How it scales: equal texts (but for ASCII case and white space) are one. First
each text is checked against the nearest of the heads of its segments, one per
segment, found by an aggregate and a join that can be split: a large group of near
copies becomes few components by as many checks as it has members, and these
grow together in the same way. Then balls are sought between components only. The members of a component under one
key are one row there, a cell, with the AND and the OR of their fingerprints: where
these agree, every member has that bit, which bounds its distance from below. Only
cells that the bound leaves are opened, so a group is never compared with itself
and no link between different groups is left out by a limit.

Defined results: a null text is empty. Texts without a word are equal to each
other and resemble nothing else; of one to four words there is one shingle, all of
them. Repeated rows are returned each. Extra columns are not read here, and kept
by ``first_resembling``. Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, saved, ship
from .components import components

WORDS, RESEMBLANCE = 5, 0.8
BITS, SEGMENTS = 128, 8
RADIUS, RADIUS_HALF = 30, 19  # of all bits, and of either half, that texts to be checked may differ in
SEED = 42
WIDTH = BITS // SEGMENTS
LANES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
FACTORS = tuple((0x9E3779B97F4A7C15 * (2 * k + 1) * (2 * k + 3)) & (1 << 64) - 1 for k in range(WORDS))  # odd, one for each place
CHUNK = 255  # shingles that a byte can count
BASE, PIECE = 0x5851F42D4C957F2D, 1 << 20  # of the polynomial, odd; bytes hashed together
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the number."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word: a polynomial over its bytes, from one running sum over all of them."""
    word = ~SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers = np.cumprod(np.full(len(data), BASE, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(LOWER[data] * powers)])
    back = np.cumprod(np.full(len(data), pow(BASE, -1, 1 << 64), dtype=np.uint64))
    return _mixed((sums[ends] - sums[starts]) * back[starts]), starts


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """For every text the hash of its words, their number, and the sorted hashes of its different shingles.

    Words are lower case in ASCII and split at space and \\t..\\r. Texts are
    taken together up to ``PIECE`` bytes, a longer one alone.
    """
    whole, counts, sets = [], [], []
    at = 0
    encoded = [(t or "").encode("utf-8") for t in texts]
    while at < len(encoded):
        end, size = at + 1, len(encoded[at])
        while end < len(encoded) and size + len(encoded[end]) < PIECE:
            size += len(encoded[end]) + 1
            end += 1
        part = encoded[at:end]
        h, starts = _word_hashes(np.frombuffer(b" ".join(part), dtype=np.uint8))
        edges = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in part)]))
        runs = np.zeros(max(0, len(h) - WORDS + 1), dtype=np.uint64)
        for k in range(WORDS):
            runs += h[k : k + len(runs)] * np.uint64(FACTORS[k])
        runs = _mixed(runs)
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n = last - first
            whole.append(xxhash.xxh64_intdigest(h[first:last].tobytes(), SEED))
            counts.append(n)
            own = np.sort(runs[first : last - WORDS + 1]) if n >= WORDS else np.array(whole[-1:] if n else [], dtype=np.uint64)
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
        at = end
    return np.array(whole, dtype=np.uint64), counts, sets


def fingerprints_of(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), 2) fingerprints: a bit is 1 where over half of a set's hashes have it; of an empty set none.

    Where it is just half, the smallest hash decides: a fixed value would make texts of few shingles alike.
    """
    out = np.zeros((len(sets), len(LANES)), dtype=np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    sizes = np.array([len(sets[i]) for i in full])
    h, at = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(sizes)])
    chunks = -(-sizes // CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    starts = np.repeat(at[:-1], chunks) + CHUNK * (np.arange(chunks.sum()) - np.repeat(first, chunks))
    for lane, number in enumerate(LANES):
        mixed = _mixed(h ^ np.uint64(number))
        counts = np.empty((len(starts), 8, 8), dtype=np.int64)  # chunk, byte, bit
        for bit in range(8):
            sums = np.add.reduceat((mixed >> np.uint64(bit)) & np.uint64(0x0101010101010101), starts)
            counts[:, :, bit] = sums.astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(counts.reshape(len(starts), 64), first, axis=0)
        least = np.unpackbits(mixed[at[:-1]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[full, lane] = np.packbits(2 * ones + least > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole, counts, sets = shingle_sets(batch.column("text").to_pylist())
        prints = fingerprints_of(sets).view(np.int64)
        kept = [n for n in batch.schema.names if n != "text"]
        new = {"n_words": pa.array(counts, pa.int64()), "same": pa.array(whole.view(np.int64)), "n": pa.array([len(s) for s in sets], pa.int64()), "f0": pa.array(prints[:, 0]), "f1": pa.array(prints[:, 1])}
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *new.values()], [*kept, *new])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole, _, sets = shingle_sets(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["same", "shingles"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= RESEMBLANCE * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), *more, F.col("text").cast("string").alias("text"))


def _segments() -> list[Column]:
    """A fingerprint's segments, each with its number above its bits."""
    per = SEGMENTS // 2
    parts = [(F.col(f), F.shiftrightunsigned(f, s * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))) for f in ("f0", "f1") for s in range(per)]
    return [p + F.lit(i << WIDTH) for i, (_, p) in enumerate(parts)]


def _ball(key: Column) -> Column:
    """The keys that differ from ``key`` in one bit at most and are not below it: of two such keys one looks up the other."""
    masks = F.array(*(F.lit(m).cast("long") for m in [0, *(1 << b for b in range(WIDTH))]))
    return F.filter(F.transform(masks, lambda m: key.bitwiseXOR(m)), lambda k: k >= key)


def _differing(a0: Column, b0: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0))


def _sizes(n: Column, m: Column) -> Column:
    return F.least(n, m) >= RESEMBLANCE * F.greatest(n, m)


def _resembling(docs: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets resemble, written; each text is read at its first row, by ids that Spark has measured."""
    met = pairs.select(F.col("a").alias("same")).union(pairs.select("b")).distinct()
    at = saved(texts.join(met, "same", "left_semi").select("same", F.col("first.doc_id").alias("at_id"), F.col("first.text_hash").alias("at_hash")), "texts-to-read")
    here = (F.col("text_hash") == F.col("at_hash")) & F.col("doc_id").eqNullSafe(F.col("at_id"))
    mine = _texts(docs).join(at, here, "left_semi").select("text")
    shingles = saved(map_texts(mine, _shingled, "same long, shingles binary").dropDuplicates(["same"]), "shingles")
    left = shingles.select(F.col("same").alias("a"), F.col("shingles").alias("sa"))
    right = shingles.select(F.col("same").alias("b"), F.col("shingles").alias("sb"))
    return saved(ship(pairs.join(left, "a").join(right, "b")).mapInArrow(_checked, "a long, b long"), "text-links")


def _near_heads(texts: DataFrame) -> DataFrame:
    """(a, b): each text with the nearest head of its segments that may resemble it."""
    keyed = texts.where("n > 0").select("same", "n", "f0", "f1", F.explode(F.array(*_segments())).alias("key"))
    heads = keyed.groupBy("key").agg(F.min(F.struct("same", "n", "f0", "f1")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = keyed.join(heads.select(F.col("key").alias("its_key"), "head"), F.col("key") == F.col("its_key"))
    far = _differing(F.col("f0"), F.col("head.f0")) + _differing(F.col("f1"), F.col("head.f1"))
    near = met.withColumn("far", far).where((F.col("same") != F.col("head.same")) & (F.col("far") <= RADIUS) & _sizes(F.col("n"), F.col("head.n")))
    best = near.groupBy("same").agg(F.min(F.struct("far", F.col("head.same").alias("head"))).alias("best"))
    return best.select(F.least("same", "best.head").alias("a"), F.greatest("same", "best.head").alias("b")).distinct()


def _near_groups(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b): each text of a group of several with the nearest head of another such group, of the first or last one under its keys."""
    rows = texts.where("n > 0").join(placed.where("NOT lone"), "same")
    keyed = rows.select("same", "n", "f0", "f1", "group", F.explode(F.array(*_segments())).alias("key"))
    head = F.struct("group", "same", "n", "f0", "f1")
    heads = keyed.groupBy(F.col("key").alias("its_key")).agg(F.min(head).alias("low"), F.max(head).alias("high")).where("low.group < high.group")
    met = keyed.join(heads, F.col("key") == F.col("its_key"))
    met = met.withColumn("head", F.when(F.col("group") != F.col("low.group"), F.col("low")).otherwise(F.col("high")))
    far = _differing(F.col("f0"), F.col("head.f0")) + _differing(F.col("f1"), F.col("head.f1"))
    near = met.withColumn("far", far).where((F.col("far") <= RADIUS) & _sizes(F.col("n"), F.col("head.n")))
    best = near.groupBy("same").agg(F.min(F.struct("far", F.col("head.same").alias("head"))).alias("best"))
    return best.select(F.least("same", "best.head").alias("a"), F.greatest("same", "best.head").alias("b")).distinct()


def _cells(rows: DataFrame) -> DataFrame:
    """(key, group, low, high, one): the members of a component under a key as one row; ``one`` is the text where it is one."""
    lone = rows.where("lone").select("key", "group", F.col("half").alias("low"), F.col("half").alias("high"), F.col("same").alias("one"))
    several = rows.where("NOT lone").groupBy("key", "group").agg(
        F.bit_and("half").alias("low"), F.bit_or("half").alias("high"), F.when(F.count(F.lit(1)) == 1, F.min("same")).alias("one")
    )
    return lone.unionByName(several)


def _between(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b): pairs of texts of different components that meet in a ball and may resemble.

    ``placed`` has same, group and lone (whether the group is that text alone).
    """
    rows = saved(texts.where("n > 0").join(placed, "same").select("same", "n", "f0", "f1", "group", "lone"), "placed-texts")
    # a key goes with the half of the fingerprint that it is not of: the own half is near by the key alone
    other = [F.col("f1")] * (SEGMENTS // 2) + [F.col("f0")] * (SEGMENTS // 2)

    def keyed(keys: Column) -> DataFrame:
        return rows.select("same", "group", "lone", F.explode(keys).alias("at")).select("same", "group", "lone", "at.key", "at.half")

    def under(half: Column):
        return lambda k: F.struct(k.alias("key"), half.alias("half"))

    pairs = list(zip(_segments(), other, strict=True))
    stored = keyed(F.array(*(under(half)(k) for k, half in pairs)))
    sought = keyed(F.flatten(F.array(*(F.transform(_ball(k), under(half)) for k, half in pairs))))
    s, q = _cells(stored).alias("s"), _cells(sought).alias("q")
    # bits that all members of both cells have, and have differently
    fixed = (F.col("s.low").bitwiseXOR(F.col("s.high"))).bitwiseOR(F.col("q.low").bitwiseXOR(F.col("q.high")))
    least = F.bit_count(F.col("s.low").bitwiseXOR(F.col("q.low")).bitwiseAND(F.bitwise_not(fixed)))
    met = s.join(q, (F.col("s.key") == F.col("q.key")) & (F.col("s.group") != F.col("q.group")) & (least <= RADIUS_HALF))
    met = saved(met.select("s.key", F.col("s.group").alias("gs"), F.col("s.one").alias("a"), F.col("q.group").alias("gq"), F.col("q.one").alias("b")), "cells-that-met")

    known = rows.select("same", F.struct("n", "f0", "f1").alias("x"))

    def near(x: Column, y: Column) -> Column:
        return (_differing(x["f0"], y["f0"]) + _differing(x["f1"], y["f1"]) <= RADIUS) & _sizes(x["n"], y["n"])

    def opened(side: DataFrame, group: str, one: str, members: DataFrame, other: str | None) -> DataFrame:
        """``side`` with a row for each member of the cells that hold several, of those near the text ``other`` where that is one."""
        mine = members.where("NOT lone").select(F.col("key").alias("its_key"), F.col("group").alias("its_group"), F.col("same").alias("member"))
        many, on = side.where(F.col(one).isNull()), (F.col("key") == F.col("its_key")) & (F.col(group) == F.col("its_group"))
        if other:
            mine = mine.join(known.select(F.col("same").alias("member"), F.col("x").alias("y")), "member")
            many = many.join(known.select(F.col("same").alias(other), "x"), other)
            on = on & near(F.col("x"), F.col("y"))
        many = many.join(mine, on)
        return side.where(F.col(one).isNotNull()).unionByName(many.withColumn(one, F.col("member")).select(side.columns))

    met = opened(met.where("b IS NULL"), "gs", "a", stored, None).unionByName(opened(met.where("b IS NOT NULL"), "gs", "a", stored, "b"))
    pairs = opened(met, "gq", "b", sought, "a")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(known.select(F.col("same").alias("a"), "x"), "a").join(known.select(F.col("same").alias("b"), F.col("x").alias("y")), "b")
    return both.where(near(F.col("x"), F.col("y"))).select("a", "b")


def resembling_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, source, n_words, same, component) of every row of ``docs``; component is one ``same`` of the group.

    ``source`` is null where ``docs`` has no such column; n_words counts words.
    """
    source = (F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")).alias("source")
    rows = saved(map_texts(_texts(docs, source), _prints, "doc_id long, text_hash long, source string, n_words long, same long, n long, f0 long, f1 long"), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    texts = rows.groupBy("same").agg(F.min(order).alias("first"), *(F.min(c).alias(c) for c in ("n", "f0", "f1")))
    texts = saved(texts, "different-texts")
    placed = texts.select("same", F.col("same").alias("group"), F.lit(True).alias("lone"))
    placed = _joined(placed, _resembling(docs, texts, saved(_near_heads(texts), "near-heads")))
    while True:  # large groups that fell apart grow together by one check a member and round
        links = _resembling(docs, texts, saved(_near_groups(texts, placed), "near-groups"))
        if links.isEmpty():
            break
        placed = _joined(placed, links)
    whole = _joined(placed, _resembling(docs, texts, saved(_between(texts, placed), "texts-apart")))
    whole = whole.select(F.col("same").alias("of"), F.col("group").alias("component"))
    named = rows.select("doc_id", "text_hash", "source", "n_words", "same").join(whole, F.col("same") == F.col("of"))
    return named.select("doc_id", "text_hash", "source", "n_words", "same", "component")


def _joined(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed`` (same, group, lone) with the groups that ``links`` (a, b) connect made one."""
    own = placed.select(F.col("same").alias("its"), F.col("group").alias("its_group"))
    between = links.join(own, F.col("a") == F.col("its")).select("b", F.col("its_group").alias("ga")).join(own, F.col("b") == F.col("its")).select("ga", "its_group")
    merged = components(between)
    out = placed.join(merged, F.col("group") == F.col("node"), "left")
    return saved(out.select("same", F.coalesce("component", "group").alias("group"), (F.col("lone") & F.col("component").isNull()).alias("lone")), "grouped-texts")


def first_resembling(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, one row of each of the ``resembling_groups``: that of the smallest id.

    If rows repeat that id, the one whose text has the smallest hash stays, once.
    Rows without id come last, so a group keeps one of them only if it has no other.
    """
    found = saved(resembling_groups(docs), "resembling")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    # per text first: copies meet in no task
    kept = found.groupBy("same", "component").agg(F.min(order).alias("first")).groupBy("component").agg(F.min("first").alias("first")).select("first")
    ids = found.select("doc_id", "text_hash", order.alias("own"))
    gone = saved(ids.join(kept, F.col("own") == F.col("first"), "left_anti").select("doc_id", "text_hash").distinct(), "texts-gone")
    repeated = saved(found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "texts-repeated")
    mine = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"))
    # few rows go or are repeated: Spark has measured both lists, and need not shuffle the texts
    left = _without(mine, gone)
    once = _within(left, repeated).groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
    return _without(left, repeated).select("row.*").unionByName(once.select("row.*"))


def _on(ids: DataFrame) -> tuple[DataFrame, Column]:
    its = ids.select(F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash"))
    return its, (F.col("text_hash") == F.col("its_hash")) & F.col("doc_id").eqNullSafe(F.col("its_id"))


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(*_on(ids), "left_anti")


def _within(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(*_on(ids), "left_semi")
