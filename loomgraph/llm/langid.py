"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the K most frequent n-grams (one to three characters
of a word, with its edges marked), best first.  A document's profile is
compared with that of each language by out-of-place distance: the sum of the
differences of ranks, K for an n-gram that the language's profile lacks.

Learning counts over all training documents: workers count by language and
slice, Spark adds the counts up and keeps the best K n-grams of each language.
The profiles of up to LANGUAGES languages are broadcast at a time; with more,
texts meet one such group after the other and keep the nearest language so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import checkpointed, table, typed

#: Length of a profile.
K = 400
#: Languages whose profiles are broadcast at a time: a matrix of at most K * LANGUAGES n-grams by LANGUAGES ranks of 4 bytes, 6.6 MB.
LANGUAGES = 64
#: Counts that a worker holds before it passes them on.
HELD = 1_000_000

_SYMBOL: np.ndarray | None = None


def symbols() -> np.ndarray:
    """For each code point: lower-case letter + 2, or 1 for anything else."""
    global _SYMBOL
    if _SYMBOL is None:
        out = np.ones(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = (ord(low) if len(low) == 1 else c) + 2
        _SYMBOL = out
    return _SYMBOL


def ngrams(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, n-gram and count, sorted by owner and then n-gram, over all texts; owner[i] is that of text i, an owner under 0 is left out.

    An n-gram is a number: its symbols in 21 bits each.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(data):
        return none
    s = symbols()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    at = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)  # in code points
    n = np.diff(at)
    # Texts with an edge before each and one at the end, and no two edges in a row.
    s = np.insert(s, at, np.uint32(1))
    own = np.append(np.repeat(owner, n + 1), -1)
    keep = s > 1
    keep[0] = True
    keep[1:] |= s[:-1] > 1
    s, own = s[keep], own[keep]
    if len(s) < 2:
        return none
    own = np.where(s > 1, own, -1)
    used = np.unique(s)
    small = np.zeros(int(used[-1]) + 1, np.uint64)
    small[used] = np.arange(1, len(used) + 1, dtype=np.uint64)
    s = small[s]
    bits = int(len(used)).bit_length()
    b = tv.U(bits)
    edge = tv.U(small[1]) if used[0] == 1 else tv.U(0)
    letter = s != edge
    two = (s[:-1] << b) | s[1:]
    two_own = np.where(letter[:-1], own[:-1], own[1:])
    three = (two[:-1] << b) | s[2:]
    code = np.concatenate([s, two, three])
    if 3 * bits + int(max(owner.max(initial=0), 1)).bit_length() > 64:  # so many letters and owners that a key would not hold both
        return halves(data, offsets, owner)
    who = np.concatenate([own, two_own, np.where(letter[1:-1], own[1:-1], -1)])
    good = who >= 0
    key = (who[good].astype(np.uint64) << tv.U(3 * bits)) | code[good]
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    mask = tv.U((1 << bits) - 1)
    back = np.concatenate(([0], used)).astype(np.uint64)
    parts = [back[(key >> tv.U(i * bits)) & mask] for i in (2, 1, 0)]
    gram = (parts[0] << tv.U(42)) | (parts[1] << tv.U(21)) | parts[2]
    return (key >> tv.U(3 * bits)).astype(np.int64), gram, count


def halves(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ngrams() by halves of the texts, or owner by owner where that is not enough."""
    whose = np.unique(owner[owner >= 0])
    if len(whose) == 1:
        raise AssertionError("one owner's letters always fit")  # 21 bits a letter
    parts = []
    for some in (whose[: len(whose) // 2], whose[len(whose) // 2 :]):
        place = np.searchsorted(some, owner)
        mine = np.where((owner >= 0) & (some[np.minimum(place, len(some) - 1)] == owner), np.minimum(place, len(some) - 1), -1)
        o, g, c = ngrams(data, offsets, mine)
        parts.append((some[o], g, c))
    return tuple(np.concatenate(x) for x in zip(*parts))


def best(owner: np.ndarray, gram: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's k most frequent n-grams, ties to the smaller number: owner, n-gram, rank."""
    # Already by owner and n-gram; a stable sort by count within owner keeps ties in order.
    most = int(count.max(initial=0)) + 1
    order = np.argsort(owner * most + (most - 1 - count), kind="stable")
    owner, gram = owner[order], gram[order]
    first = np.searchsorted(owner, owner, "left")
    rank = np.arange(len(owner)) - first
    keep = rank < k
    return owner[keep], gram[keep], rank[keep]


class Model:
    """Profiles of some languages as one matrix of ranks."""

    def __init__(self, rows: list[tuple[str, int, int]], k: int = K):
        self.k = k
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.uint64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), k, np.int32)
        column = {x: i for i, x in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, np.uint64(gram)), column[lang]] = rank

    def nearest(self, doc: np.ndarray, gram: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document of a profile (sorted by document), the place of the nearest language and its distance; ties to the language that sorts first."""
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        theirs = self.ranks[at]
        away = np.where(theirs < self.k, np.abs(theirs - rank[:, None]), self.k)
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        total = np.add.reduceat(away, first, axis=0).astype(np.int64)
        pick = total.argmin(1)
        return pick, total[np.arange(len(first)), pick]


def nearest_of(models: list[Model], data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[list[str], np.ndarray]:
    """Language and score (1 - distance / largest distance) of each text; models hold languages in order."""
    n = len(offsets) - 1
    lang, score = ["und"] * n, np.zeros(n)
    doc, gram, rank = best(*ngrams(data, offsets, np.arange(n)), k)
    if not len(doc) or not models:
        return lang, score
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    size = np.diff(np.append(first, len(doc)))
    least = np.full(len(first), np.iinfo(np.int64).max)
    for m in models:
        pick, total = m.nearest(doc, gram, rank)
        better = np.flatnonzero(total < least)
        least[better] = total[better]
        for i in better.tolist():
            lang[doc[first[i]]] = m.langs[pick[i]]
    score[doc[first]] = 1 - least / (size * k)
    return lang, score


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0. A null id counts as the empty text (held out)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", k: int = K, languages: int = LANGUAGES) -> list:
    """Broadcast models of up to so many languages each, in order of language, from all rows of docs with a language; rows without one or without text teach nothing.

    At most k n-grams of each of those languages are on the driver at a time.
    """
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            owner, gram, count = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((gram, owner))
            owner, gram, count = owner[order], gram[order], count[order]
            first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1]))))
            return owner[first], gram[first], np.add.reduceat(count, first)

        def out(owner: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
            every = pa.array(list(names), pa.string())
            return typed([{"lang": every.take(pa.array(owner)), "gram": gram.astype(np.int64), "count": count}], schema)

        for b, data, offsets in tv.pieces(batches, "text"):
            owner = np.array([names.setdefault(x, len(names)) for x in b.column(1).to_pylist()], np.int64)
            held.append(ngrams(data, offsets, owner))
            if sum(len(x[0]) for x in held) > HELD:
                held[:] = [merged()] if len(held) > 1 else held
                if len(held[0][0]) > HELD // 2:
                    yield from out(*held.pop())
        held = [x for x in held if len(x[0])]
        if held:
            yield from out(*merged())

    counts = docs.where(docs[lang].isNotNull() & docs[text].isNotNull()).select(docs[text].alias("text"), docs[lang].alias("lang")).mapInArrow(run, "lang string, gram long, count long")
    total = counts.groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "gram"))).where(F.col("rank") <= k)
    ranked = checkpointed(ranked.select("lang", "gram", F.col("rank") - 1))
    models, after = [], None
    while True:
        some = ranked if after is None else ranked.where(F.col("lang") > after)
        names = [r[0] for r in some.select("lang").distinct().orderBy("lang").limit(languages).collect()]
        if not names:
            return models
        rows = some.where(F.col("lang") <= names[-1]).collect()
        models.append(docs.sparkSession.sparkContext.broadcast(Model([tuple(r) for r in rows], k)))
        after = names[-1]


def predict(docs: DataFrame, models: list, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' columns keep, and lang_pred and score, for every row; `und` and 0 for texts that are null or have no letter."""
    chosen = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    names = [f.name for f in chosen.schema.fields[:-1]]
    kind = chosen.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in tv.pieces(batches, "__text"):
            lang, score = nearest_of([m.value for m in models], data, offsets)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return chosen.mapInArrow(run, kind)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts all: doc_id, held_out, lang_pred, score.

    Repeated rows stay; extra columns are left out; an empty table, or one
    without a labelled row, gives `und` with score 0 for each row there is.
    """
    models = learn(docs.where(~held_out(docs[key])), text, lang)
    made = predict(docs.select(docs[key].cast("long").alias("doc_id"), held_out(docs[key]).alias("held_out"), docs[text].alias("text")), models, keep=("doc_id", "held_out"))
    return made.withColumnRenamed("doc_id", key)


def op6_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(table(spark, sf_dir, "documents"))
