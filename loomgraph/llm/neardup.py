"""Near-duplicate groups by MinHash bands, odd sketches and an exact check.

1.  Documents with equal shingle sets are one class; only classes go on.
2.  One-permutation MinHash gives bands; classes that share a band meet in a
    bucket.
3.  The odd sketch of a class is the parity bitmap of its MinHash samples: the
    smallest hash in each of SAMPLES ranges that has any.  The number of ones
    in the XOR of two sketches estimates how many samples differ, precisely
    where sets are alike, so it rejects most pairs that only share a band.
4.  What is left is confirmed on the full shingle sets.
5.  Buckets are compared star-wise first: every member with the bucket's most
    central member.  Only members that the links so far do not join to it are
    then compared with the other members of the bucket, block against block,
    and only pairs that pass the sketches leave a block.  A large group of
    near copies thus costs about as many comparisons as it has members, and
    no link between different components is lost.
6.  Components of the confirmed links by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import checkpointed, table, typed

#: Words in a shingle; MinHash bands and values in each: two sets of similarity 0.85 miss all bands with a probability of 7e-8 (0.8: 1.5e-5).
WORDS, BANDS, ROWS = 5, 28, 5
#: Bits of an odd sketch, and MinHash samples that it folds.
BITS, SAMPLES = 2048, 4096
#: Standard deviations that a pair may be off and still be looked at.
SIGMAS = 5.0
#: Members that one task compares with each other: rows of a block on either side.
BLOCK = 512
#: Ids that are broadcast to find their texts (8 bytes each); more are joined.
BROADCAST_IDS = 200_000
H = 52  # bits of a shingle's hash, after those for the document's place in its slice

_BORROW = np.random.default_rng(5).integers(0, BANDS * ROWS, (48, BANDS * ROWS))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document as sorted hashes laid end to end, and where each document's begin (len + 1)."""
    h, first = tv.word_hashes(data, offsets, lower=True)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    grams = tv.grams_hash(h, k)
    inside = doc[: len(grams)] == doc[k - 1 :] if len(grams) else np.zeros(0, bool)
    keys = [(doc[: len(grams)][inside] << tv.U(H)) | (grams[inside] >> tv.U(64 - H))]
    for m in range(1, k):  # fewer words: the whole sequence
        short = np.flatnonzero(n == m)
        if len(short):
            keys.append((short.astype(np.uint64) << tv.U(H)) | (tv.mix(tv.grams_hash(h, m)[first[short]] + tv.U(m)) >> tv.U(64 - H)))
    keys = np.concatenate(keys)
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    at = np.searchsorted(keys, np.arange(len(n) + 1, dtype=np.uint64) << tv.U(H))
    return keys & tv.U((1 << H) - 1), at


def set_keys(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each document's whole set; 0 for an empty one."""
    total = np.concatenate(([tv.U(0)], np.cumsum(tv.mix(sets + tv.U(0x51ED27)))))
    return np.where(np.diff(at) > 0, tv.mix((total[at[1:]] - total[at[:-1]]) ^ tv.mix(np.diff(at).astype(np.uint64))) | tv.U(1), tv.U(0))


def bands(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Band keys (documents x BANDS) from one permutation: the smallest hash in each of BANDS * ROWS ranges; empty ranges borrow from others by a fixed sequence."""
    n, bins = np.diff(at), BANDS * ROWS
    doc = np.repeat(np.arange(len(n)), n)
    bin_ = ((sets >> tv.U(20)) * tv.U(bins) >> tv.U(H - 20)).astype(np.int64)
    place = doc * bins + bin_
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
    none = tv.U(2**64 - 1)
    sign = np.full(len(n) * bins, none, np.uint64)
    sign[place[first]] = sets[first]
    sign = sign.reshape(-1, bins)
    full = sign.copy()
    for borrow in _BORROW:
        rows, cols = np.nonzero((full == none) & (n[:, None] > 0))
        if not len(rows):
            break
        full[rows, cols] = sign[rows, borrow[cols]]
    rest = np.flatnonzero(((full == none) & (n[:, None] > 0)).any(1))
    for i in rest.tolist():  # very few shingles: the next range that has one
        have = np.flatnonzero(sign[i] != none)
        empty = np.flatnonzero(full[i] == none)
        full[i, empty] = sign[i, have[np.searchsorted(have, empty) % len(have)]]
    out = np.zeros((len(n), BANDS), np.uint64)
    for r in range(ROWS):
        out = tv.mix(out * tv.U(0x9E3779B97F4A7C15) + full[:, r::ROWS])
    return tv.mix(out + np.arange(BANDS, dtype=np.uint64) * tv.U(0xD6E8FEB86659FD93))


def odd_sketches(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity bitmaps (documents x BITS / 8 bytes) of the sets' MinHash samples, one of each range that has a hash."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    keep = np.zeros(0, bool)
    if len(sets):
        place = doc * SAMPLES + ((sets >> tv.U(20)) * tv.U(SAMPLES) >> tv.U(H - 20)).astype(np.int64)
        keep = np.concatenate(([True], place[1:] != place[:-1]))  # hashes are sorted, so the first of a range is its smallest
    bit = (tv.mix(sets[keep]) & tv.U(BITS - 1)).astype(np.int64)
    odd = np.bincount(doc[keep] * BITS + bit, minlength=len(n) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, BITS), axis=1)


def near_enough(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sketches a and b (uint64 words, last axis) allow a similarity of percent. na, nb: sizes of the sets.

    At similarity t, the two sets have (na + nb) / (1 + t) hashes together, of
    which a share of 1 - t is in one of them only.  A range whose smallest hash
    is such a one differs by that sample, and by another if the other set has
    any hash there.  So the samples that differ are bounded by the ranges in
    use (large sets) and by the hashes in one set only (small ones); the lesser
    bound counts, at any size.
    """
    t = percent / 100
    ones = np.bitwise_count(a ^ b).sum(-1).astype(np.int64)
    both = (na + nb) / (1 + t)
    load = both / SAMPLES  # hashes of both in a range
    used = SAMPLES * -np.expm1(-load)  # ranges that have any
    more = -np.expm1(-load)  # whether a range has another hash
    d = np.minimum(
        used * (1 - t) * (1 + more) + SIGMAS * (1 + more) * np.sqrt(used * t * (1 - t)),
        both * (1 - t) * (1 + more) + SIGMAS * np.sqrt(both * (1 - t) * more * (1 - more)),
    )
    e = np.exp(-4 * d / BITS)
    most = BITS / 2 * (1 - np.sqrt(e)) + SIGMAS * np.sqrt(BITS / 4 * np.maximum(1 - e * (1 + 4 * d / BITS), 0)) + 1
    sizes = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    return sizes & (ones <= most)


SIGNED = "doc_id long, n long, cls long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, n (size of the shingle set), cls (hash of the set, 0 if empty), bands and sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in tv.pieces(batches, "text"):
            sets, at = shingle_sets(data, offsets)
            keys = bands(sets, at).view(np.int64)
            raw = odd_sketches(sets, at).tobytes()
            size = BITS // 8
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
            yield from typed([{"doc_id": b.column(0), "n": np.diff(at), "cls": set_keys(sets, at).view(np.int64), "bands": made, "sketch": [raw[i * size : (i + 1) * size] for i in range(len(keys))]}], schema)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SIGNED)


def words_of(column: pa.Array) -> np.ndarray:
    """Binary sketches as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITS // 64)


def sifted(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                good = near_enough(words_of(x.column(4)), words_of(x.column(5)), x.column(2).to_numpy(), x.column(3).to_numpy(), percent)
                yield x.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """The pairs of classes whose full shingle sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = checkpointed(ids.join(classes, "cls").select("cls", F.col("doc_id").alias("wanted")))
    small = wanted.count() <= BROADCAST_IDS
    reps = wanted.select("wanted").distinct()
    texts = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    texts = texts.join(F.broadcast(reps) if small else reps, F.col("doc_id") == F.col("wanted"), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cls", pa.int64()), ("set", pa.binary())])
        for b, data, offsets in tv.pieces(batches, "text"):
            own, at = shingle_sets(data, offsets)
            raw = own.tobytes()
            yield from typed([{"cls": set_keys(own, at).view(np.int64), "set": [raw[8 * i : 8 * j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]}], schema)

    full = texts.select("text").mapInArrow(sets, "cls long, set binary").dropDuplicates(["cls"])
    side = lambda c: full.select(F.col("cls").alias(c), F.col("set").alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            good = []
            for p, q in zip(x.column(2), x.column(3)):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                same = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0
                good.append(100 * same >= percent * (len(p) + len(q) - same) and same > 0)
            yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id and root (the smallest id reachable) of every id in edges (a, b), by alternating large and small stars."""

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = summary(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small stars: each edge points from the larger end to the smaller.
        large = checkpointed(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, large["a"] == low["u"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        now = checkpointed(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        last, seen = seen, summary(now)
        if last == seen:
            break
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return ends.unionByName(ends.select(F.col("root").alias("id"), "root").distinct())


def in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and pass the sketches.

    members: bucket, cls, comp, main (component of the bucket's centre), size
    and rest (members of the bucket, and those outside main), n, sketch, bands.
    A pair leaves only the smallest of the buckets it shares; if that is none
    of these, it had two members, and its star has compared them.
    """
    outside = F.col("comp") != F.col("main")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(n / F.lit(BLOCK)).cast("int") - 1))
    place = lambda n: F.pmod(F.xxhash64("cls"), F.ceil(n / F.lit(BLOCK))).cast("int")
    left = members.where(outside).withColumn("p", place(F.col("rest"))).withColumn("q", spread(F.col("size"))).withColumn("side", F.lit(0))
    right = members.withColumn("p", spread(F.col("rest"))).withColumn("q", place(F.col("size"))).withColumn("side", F.lit(1))
    columns = ["bucket", "p", "q", "side", "cls", "comp", "main", "n", "sketch", "bands"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side, cls, comp, main, n = (t.column(c).to_numpy() for c in ("side", "cls", "comp", "main", "n"))
        words = words_of(t.column("sketch"))
        keys = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        bucket = t.column("bucket")[0].as_py()
        us, vs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        for u in us.tolist():
            v = vs[(comp[vs] != comp[u]) & ((comp[vs] == main[u]) | (cls[vs] > cls[u]))]
            if len(v):
                v = v[near_enough(words[v], words[u], n[v], n[u], percent)]
                v = v[np.where(keys[v] == keys[u], keys[v], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max) == bucket]
                out.append(np.stack([np.minimum(cls[v], cls[u]), np.maximum(cls[v], cls[u])]))
        a, b = np.concatenate(out, 1) if out else (np.zeros(0, np.int64),) * 2
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return left.select(*columns).unionByName(right.select(*columns)).groupBy("bucket", "p", "q").applyInArrow(run, "a long, b long")


def groups(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row a row of docs.

    Words are lower-cased in A-Z only.  A document of fewer than five words has
    its whole sequence as the one shingle; without words or text it has none
    and is linked with nothing.  Rows of one doc_id are one document with
    several texts, and so in one component.  Rows without a doc_id are linked
    with nothing, have no component_id, and are kept.  component_id is the
    smallest doc_id of the component; other columns are left out.
    """
    signed = checkpointed(signatures(docs, key, text))
    known = signed.where("n > 0 and doc_id is not null")
    classes = checkpointed(known.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch")))
    bucketed = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = checkpointed(bucketed.join(shared, "bucket"))
    # The centre of a bucket is the member that meets most others in all its buckets: in a family of edited copies, the least edited one.
    weight = members.groupBy("cls").agg(F.sum("size").alias("weight"))
    centres = members.join(weight, "cls").groupBy("bucket").agg(F.max(F.struct("weight", "cls"))["cls"].alias("centre"))
    stars = members.join(centres, "bucket").where("centre <> cls").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct()
    light = classes.select("cls", "n", "sketch", "bands")
    first = checkpointed(confirmed(checkpointed(sifted(stars, light, percent)), classes.select("cls", "doc_id"), docs, key, text, percent))
    # Documents of several texts join their classes.
    each = known.select("doc_id", "cls").distinct()
    several = each.join(each.groupBy("doc_id").agg(F.min("cls").alias("a")), "doc_id").where("a <> cls").select("a", F.col("cls").alias("b"))
    comp = checkpointed(components(first.unionByName(several)))
    named = members.join(comp, members["cls"] == comp["id"], "left").select("bucket", "cls", F.coalesce("root", "cls").alias("comp"))
    main = centres.join(comp, F.col("centre") == comp["id"], "left").select("bucket", F.coalesce("root", "centre").alias("main"))
    placed = named.join(main, "bucket")
    left = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("comp") != F.col("main")).alias("rest")).where("rest > 0 and size > 2")
    second = checkpointed(in_blocks(placed.join(left, "bucket").join(light, "cls"), percent).distinct())
    more = confirmed(second, classes.select("cls", "doc_id"), docs, key, text, percent)
    final = components(comp.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b").unionByName(more))
    rooted = classes.select("cls", "doc_id").join(final, F.col("cls") == F.col("id"), "left").select("cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    label = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labelled = rooted.join(label, "root").select("cls", "component_id")
    out = signed.select("doc_id", "n", "cls").join(labelled, "cls", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    made = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return made.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).withColumnRenamed("doc_id", key)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents."""
    return groups(table(spark, sf_dir, "documents"))
