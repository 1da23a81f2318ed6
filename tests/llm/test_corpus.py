"""Near copies, repeated passages, language, scores, searches and the pipeline."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from loomgraph.llm import ann, blocks, knn, langid, neardup, scoring, substrings  # noqa: E402
from loomgraph.llm import textvec as tv  # noqa: E402

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, lower=False):
    b = (text or "").encode()
    return (b.translate(LOW) if lower else b).split()


def shingles(text):
    w = words(text, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(rows, percent):
    """Components by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if i == j or both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, rows, empty, percent):
    want = linked(rows, percent)
    made = neardup.groups(docs, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in made) == Counter((i, len(shingles(t))) for i, t, _ in rows)
    assert {r["doc_id"]: r["component_id"] for r in made if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in made) and len(set(want.values())) < len(want) - 20
    if percent == 85:
        assert neardup.groups(empty).count() == 0


def test_small_blocks_lose_no_link(docs, rows, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    some = docs.where("doc_id between 200 and 299")
    assert {r["doc_id"]: r["component_id"] for r in neardup.groups(some, 85).collect()} == linked([x for x in rows if x[0] and 200 <= x[0] < 300], 85)


def test_sketches_reject_no_true_pair():
    r = np.random.default_rng(3)
    for n in (8, 60, 300, 900, 1024, 1500, 8000, 40000):
        for _ in range(40):
            base = r.integers(0, 1 << 52, n + n // 5, dtype=np.uint64)
            k = int(0.15 / 1.85 * n)
            a, b = np.unique(base[:n]), np.unique(np.concatenate([base[k:n], base[n : n + k]])) if k else np.unique(base[:n])
            same = len(np.intersect1d(a, b))
            if 100 * same < 85 * (len(a) + len(b) - same):
                continue
            at = np.array([0, len(a), len(a) + len(b)])
            s = neardup.odd_sketches(np.concatenate([a, b]), at).view(np.uint64)
            assert neardup.near_enough(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]), 85).all()


@pytest.mark.parametrize("n", [60, 300, 1024, 1500, 8000])
def test_sketches_reject_most_far_pairs(n):
    r, passed = np.random.default_rng(4), 0
    for _ in range(40):
        base = r.integers(0, 1 << 52, 2 * n, dtype=np.uint64)
        k = int(0.35 * n)  # similarity about 0.48
        a, b = np.unique(base[:n]), np.unique(base[k : n + k])
        at = np.array([0, len(a), len(a) + len(b)])
        s = neardup.odd_sketches(np.concatenate([a, b]), at).view(np.uint64)
        passed += int(neardup.near_enough(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]), 85)[0])
    assert passed <= 4


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
@settings(max_examples=6, deadline=None)
def test_components(spark, pairs):
    parent = list(range(26))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    made = {r["id"]: r["root"] for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert made == {i: find(i) for p in pairs if p[0] != p[1] for i in p}


def windows_removed(rows, window):
    seen = Counter()
    for _, t, *_ in rows:
        w = words(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("window", "frequent"), [(35, 4096), (35, 3), (10, 4096), (3, 5)])
def test_repeated_passages(docs, rows, empty, monkeypatch, window, frequent):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    made = substrings.marked(docs, window).withColumn("h", F.sha2(F.col("kept").cast("binary"), 256))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["h"]) for r in made.collect()) == windows_removed(rows, window)
    assert substrings.marked(empty, window).count() == 0


def test_passages_of_equal_power_sums_stay(spark):
    flips = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = "".join("ab"[x] for x in flips), "".join("ba"[x] for x in flips)
    pad = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{a} " + " ".join(f"x{i}" for i in range(40))), (2, f"{b} " + " ".join(f"y{i}" for i in range(40))), (3, " ".join([a] * 40)), (4, " ".join([b] * 20)), (5, " ".join("ab"[x] for x in flips[:1024])), (6, pad), (7, f"{pad} z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = substrings.marked(df).withColumn("h", F.sha2(F.col("kept").cast("binary"), 256))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["h"]) for r in made.collect())
    assert got == windows_removed(rows, 35) and {i: n for i, _, n, _ in got}[1] == 0 and {i: n for i, _, n, _ in got}[4] == 0
    assert {r["doc_id"]: r["component_id"] for r in neardup.groups(df).collect()} == linked(rows, 85)


def test_untouched_texts_stay(docs, rows):
    made = substrings.marked(docs, keep=("lang", "kept"), prefix="own_", verbatim=True)
    got = Counter((r["doc_id"], r["kept"], r["own_lang"], r["own_kept"]) for r in made.where("n_removed = 0").collect())
    assert got and got <= Counter((i, t, lang, "clash") for i, t, lang in rows)


@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=14), min_size=1, max_size=6), st.integers(1, 2))
@settings(max_examples=200, deadline=None)
def test_automaton_counts(strings, times):
    m = substrings.SuffixAutomaton()
    for s in strings:
        m.add(s, times)
    m.close()
    seen = Counter(tuple(s[i : i + 3]) for s in strings for i in range(len(s) - 2))
    for s in strings:
        want = sum(1 << i for i in range(len(s) - 2) if times * seen[tuple(s[i : i + 3])] > 1)
        assert m.repeated(s, 3) == want


def test_language(spark, empty):
    base = {"en": "the cat and the dog were here with others ", "fr": "le chat et la souris étaient là avec les autres ", "de": "der hund und die katze waren hier mit den anderen "}
    rows = [(i, " ".join(np.random.default_rng(i).permutation((base[k] * 5).split())), k) for i, k in enumerate(list(base) * 40)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 !!", "fr"), (903, "the dog and the cat", None), (None, "le chat et la souris", None), (903, "the dog and the cat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x")).withColumn("held_out", F.lit(1))
    made = langid.identify(df).collect()
    got = {r["doc_id"]: r for r in made}
    assert len(made) == len(rows) and all(got[i]["lang_pred"] == k for i, _, k in rows[:120])
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in made)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "en", "fr"] and all(0 <= r["score"] <= 1 for r in made)
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@given(st.lists(st.text(st.sampled_from(list("abcÀé \n1日ß")), max_size=12), max_size=8))
@settings(max_examples=100, deadline=None)
def test_ngrams(texts):
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    owner, gram, count = langid.ngrams(np.frombuffer(data, np.uint8), offsets, np.arange(len(texts)))
    got = {(o, g): c for o, g, c in zip(owner.tolist(), gram.tolist(), count.tolist())}
    want = Counter()
    for i, t in enumerate(texts):
        for w in "".join(c if c.isalpha() else " " for c in t).split():
            s = [1, *(ord(c.lower()) + 2 if len(c.lower()) == 1 else ord(c) + 2 for c in w), 1]
            for k in range(1, len(s) - 1):
                want[i, s[k]] += 1
            for k in range(len(s) - 1):
                want[i, s[k] << 21 | s[k + 1]] += 1
            for k in range(len(s) - 2):
                want[i, s[k] << 42 | s[k + 1] << 21 | s[k + 2]] += 1
    assert got == dict(want)


def language_by_hand(rows, k=langid.K):
    """doc_id, language and score by ranks in plain Python."""

    def profile(texts):
        seen = Counter()
        for t in texts:
            for w in "".join(c if c.isalpha() else " " for c in t or "").split():
                s = [1, *(ord(c.lower()) + 2 if len(c.lower()) == 1 else ord(c) + 2 for c in w), 1]
                for i in range(len(s)):
                    if 0 < i < len(s) - 1:
                        seen[s[i]] += 1
                    if i + 1 < len(s):
                        seen[s[i] << 21 | s[i + 1]] += 1
                    if i + 2 < len(s):
                        seen[s[i] << 42 | s[i + 1] << 21 | s[i + 2]] += 1
        return [g for g, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:k]]

    taught = defaultdict(list)
    for i, t, lang in rows:
        if lang is not None and t is not None and zlib.crc32(str(i if i is not None else "").encode()) % 5:
            taught[lang].append(t)
    ranks = {lang: {g: r for r, g in enumerate(p)} for lang, ts in sorted(taught.items()) if (p := profile(ts))}
    out = Counter()
    for i, t, _ in rows:
        own = profile([t])
        away = [(sum(abs(theirs[g] - r) if g in theirs else k for r, g in enumerate(own)), lang) for lang, theirs in ranks.items()] if own else []
        d, lang = min(away, default=(0, "und"))
        out[(i, lang, round(1 - d / (len(own) * k), 9) if away else 0.0)] += 1
    return out


def test_language_is_the_nearest_profile(spark, docs, rows):
    want = language_by_hand(rows)
    made = langid.identify(docs).collect()
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in made) == want
    r = np.random.default_rng(2)
    many = [(i, " ".join("".join(r.choice(list("abcdefgh"), 4)) for _ in range(6)), f"l{i % 9}") for i in range(60)]
    df = spark.createDataFrame(many, "doc_id long, text string, lang string")
    models = langid.learn(df.where(~langid.held_out(df["doc_id"])), languages=2)  # groups of languages, ties among them to the first
    made = langid.predict(df, models, keep=("doc_id",)).collect()
    assert len(models) == 5 and Counter((x["doc_id"], x["lang_pred"], round(x["score"], 9)) for x in made) == language_by_hand(many)


def test_many_letters_and_owners():
    texts = ["".join(chr(0x4E00 + (37 * i + j) % 20000) for j in range(300)) for i in range(600)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = langid.ngrams(data, offsets, np.arange(600) * 2**20)
    plain = langid.ngrams(data, offsets, np.arange(600))
    assert (whole[0] == plain[0] * 2**20).all() and (whole[1] == plain[1]).all() and (whole[2] == plain[2]).all()


def model_scores(rows, quantised):
    """score of each row by exact counts of words, pairs and triples."""
    one, two, three = Counter(), Counter(), Counter()
    teaches = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2
    for i, t, _ in rows:
        if teaches(i):
            w = [*words(t, True), None]
            one.update([0, *w])
            two.update(zip([0, *w[:-1]], w))
            three.update(zip([0, *w[:-2]], w[:-1], w[1:]))
    q = lambda c: float(scoring.LEVELS[scoring.levels_of(np.array([c]))[0]]) if c and quantised else float(c)
    total, distinct, m = sum(one.values()) - one[0], len(one) - 1, scoring.MASS
    out = []
    for i, t, _ in rows:
        w, s = [0, *words(t, True), None], 0.0
        for k in range(1, len(w)):
            p = (q(one[w[k]]) + 1) / (total + distinct + 1)
            p = (min(q(two[w[k - 1], w[k]]), q(one[w[k - 1]])) + m * p) / (q(one[w[k - 1]]) + m)
            if k > 1:
                context = q(two[w[k - 2], w[k - 1]])
                p = (min(q(three[w[k - 2], w[k - 1], w[k]]), context) + m * p) / (context + m)
            s += math.log10(p)
        out.append((i, len(w) - 1, s))
    return out


def test_scores(spark, docs, rows, empty, monkeypatch):
    count = Counter()
    for i, t, _ in rows:
        if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2:
            count.update([*words(t, True), None])
    total, distinct = sum(count.values()), len(count)
    want = Counter()
    for i, t, _ in rows:
        w = [*words(t, True), None]
        want[(i, zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2, len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w), 6))] += 1
    made = scoring.scored(docs).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in made) == want
    # False answers of the filter move scores a little; without them, they are the model's.
    near = sorted((str(i), n, s) for i, n, s in model_scores(rows, True))
    for (i, n, s), r in zip(near, sorted(made, key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["score"]))):
        assert (i, n) == (str(r["doc_id"]), r["n_tokens"]) and abs(r["score"] - s) < 0.04 * n + 0.5
    monkeypatch.setattr(scoring, "SLICE", 4000)
    for broadcast in (0, scoring.BROADCAST):
        exact = scoring.scored(docs, broadcast=broadcast, bits=400).collect()
        assert Counter((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in exact) == Counter((str(i), n, round(s, 6)) for i, n, s in model_scores(rows, True))
    assert scoring.scored(empty).count() == 0


def test_scores_depend_on_the_tables_only(spark, docs, monkeypatch):
    monkeypatch.setattr(scoring, "SLICE", 20_000)
    seen = set()
    for width, broadcast in ((4, 0), (4, scoring.BROADCAST), (32, 0), (61, 0)):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        seen.add(tuple(sorted(map(str, scoring.scored(docs.repartition(width % 5 + 1), broadcast=broadcast).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1


def test_rows_that_repeat_in_full_are_spread(spark, docs, monkeypatch):
    many = docs.unionByName(docs.where("doc_id in (500, 20)").crossJoin(spark.range(60)).drop("id"))
    whole = {f.__name__: Counter(map(tuple, f(many).collect())) for f in (substrings.marked, scoring.scored)}
    assert blocks.dealt(many, "doc_id", "text", 1).where("doc_id = 500").select("block").distinct().count() == 1
    for sent in (1, blocks.SENT):
        monkeypatch.setattr(blocks, "REPEATS", 9000)
        monkeypatch.setattr(blocks, "SENT", sent)
        apart = blocks.dealt(many, "doc_id", "text", 1, keep=("block",))
        assert apart.where("doc_id = 500").count() == 61 and apart.where("doc_id = 500").select("block").distinct().count() > 8
        assert apart.where("doc_id = 9").select("block").distinct().count() == 1 and apart.count() == many.count()
        for f in (substrings.marked, scoring.scored):
            assert Counter(map(tuple, f(many).collect())) == whole[f.__name__]


def test_filter_never_understates():
    r = np.random.default_rng(1)
    keys, counts = np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64)), r.geometric(0.3, 5000)
    f = scoring.Filter(*scoring.joined({0: scoring.built(keys, counts[: len(keys)])}, 1))
    assert (f.levels(keys) >= scoring.levels_of(counts[: len(keys)])).all()
    assert (f.levels(r.integers(0, 1 << 63, 5000, dtype=np.uint64)) > 0).mean() < 0.03


def table(spark, n, dim=16, seed=0):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim)).astype("f4") * r.choice([0.1, 1, 9], (n, 1)).astype("f4")
    v[5:9] = v[4]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan")] * dim), (n + 3, [1.0, None]), (n + 4, [float("inf")] * dim), (n + 5, [1.0, 2.0]), (None, [1.0] * dim), (10, v[10].tolist()), (n + 6, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vec", F.lit("clash")).withColumn("dim", F.lit("clash")), rows


def brute(rows, k, query, scale):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (scale or any(v)):
            x = np.array(v, np.float32).astype(float)
            good[i] = np.floor(x * scale) if scale else x
    out = {}
    for i, q in good.items():
        if query(i):
            s = sorted((-(float(q @ v)), j) for j, v in good.items() if j != i and len(v) == len(q))[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


@pytest.mark.parametrize("n", [0, 30, 700])
def test_exact_search(spark, n):
    df, rows = table(spark, max(n, 12))
    if not n:
        df, rows = df.limit(0), []
    got = defaultdict(list)
    for r in sorted(knn.top_k(df, F.col("vec_id") % 5 == 0, 10).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = {i: v for i, v in brute(rows, 10, lambda i: i % 5 == 0, 1024).items() if v}
    assert got == want


def test_exact_search_of_large_components(spark):
    big = [(0, [3e37, 1.0]), (1, [2e37, 5.0]), (2, [-3e37, 2.0]), (3, [1.0, 1.0])]
    made = knn.top_k(spark.createDataFrame(big, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, 3).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(made, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


def test_exact_search_of_small_queries_in_large_rows(spark):
    rows = [(0, [1.0, 3.0]), (1, [float(2**40 + 2**18), 1.0]), (2, [float(2**40), 2.0]), (3, [float(2**40), 2.0 + 1 / 1024]), (4, [-1.0, 2.0])]
    made = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = sorted(((-sum(a * b for a, b in zip(whole[0], v)), i) for i, v in whole.items() if i))[:3]
    assert [(r["vec_id"], r["score"]) for r in sorted(made, key=lambda r: r["rank"])] == [(i, -s) for s, i in want]
    large = [(0, [3.3e15, 1.0]), *((i, [2.2e15 + i, 7.0 * i]) for i in range(1, 20))]
    made = knn.top_k(spark.createDataFrame(large, "vec_id long, embedding array<double>"), F.col("vec_id") == 5, 4).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in large}
    want = sorted((-min(sum(a * b for a, b in zip(whole[5], v)), 2**63 - 1), i) for i, v in whole.items() if i != 5)[:4]
    assert [(r["vec_id"], r["score"]) for r in sorted(made, key=lambda r: r["rank"])] == [(i, -s) for s, i in want]


@pytest.mark.parametrize("search", [knn.top_k, ann.nearest])
def test_query_rows_of_one_id_have_lists_of_their_own(spark, search):
    r = np.random.default_rng(5)
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0])] + [(i, r.normal(size=2).tolist()) for i in range(1, 8)]
    made = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5).collect()
    assert Counter(r["rank"] for r in made) == {k: 2 for k in range(1, 6)} and {r["query_id"] for r in made} == {0}
    lists = defaultdict(list)
    for x in sorted(made, key=lambda x: x["rank"]):
        lists[x["rank"]].append(x["vec_id"])
    first = {max(range(1, 8), key=lambda i: rows[i + 2][1][c]) for c in (0, 1)}
    assert set(lists[1]) == first


def test_equal_vectors_have_equal_scores(spark):
    r = np.random.default_rng(8)
    same, base = r.normal(size=33).tolist(), r.normal(size=(300, 33))
    rows = [(i, same if i % 3 == 0 else base[i].tolist()) for i in range(300)]
    made = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 3, 20).collect()
    assert [(x["vec_id"], x["rank"]) for x in sorted(made, key=lambda x: x["rank"])] == [(3 * k, n) for n, k in enumerate([0, *range(2, 21)], 1)]
    assert len({x["score"] for x in made}) == 1


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_with_the_shipped_parameters(spark, size):
    path = f"/root/testdata/{size}"
    if not os.path.exists(path):
        pytest.skip("the driver's tables are not here")
    got = defaultdict(set)
    for x in ann.op3_multiprobe_neighbours(spark, path).collect():
        got[x["query_id"]].add(x["vec_id"])
    rows = [(x["vec_id"], x["embedding"]) for x in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows, 20, lambda i: i % 20 == 0, 0)
    assert set(got) == set(want) and np.mean([len({j for j, _ in v} & got[i]) / len(v) for i, v in want.items()]) >= 0.9


def test_approximate_search(spark):
    df, rows = table(spark, 3000)
    got = defaultdict(dict)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    want = brute(rows, 20, lambda i: i % 20 == 0, 0)
    recall = np.mean([len({j for j, _ in v} & set(got[i])) / len(v) for i, v in want.items() if v])
    assert recall >= 0.9 and all(len(got[i]) == len(v) for i, v in want.items())
    assert all(abs(got[i][j] - s) < 1e-9 for i, v in want.items() for j, s in v if j in got[i])
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0, 20).count() == 0


def test_words_are_split_at_ascii_space():
    t = ["a b", "", "\x0bx\x1cy\r\n", " ", "é z"]
    data, offsets = np.frombuffer("".join(t).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in t)])
    s, e, first = tv.words(data, offsets)
    raw = data.tobytes()
    assert [[raw[a:b] for a, b in zip(s[i:j], e[i:j])] for i, j in zip(first, first[1:])] == [x.encode().split() for x in t]


def test_pipeline(spark, docs, rows, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at, names = docs, [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "packing"]
    kept = {}
    for name, stage in pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, at, str(tmp_path)).write.parquet(out)
        at = spark.read.parquet(out)
        kept[name] = at.collect()
        if name != "packing":
            assert at.columns == docs.columns
    first = Counter((r["doc_id"], r["text"]) for r in kept["language_id"])
    assert first <= Counter((i, t) for i, t, _ in rows) and (400, None) not in first and (406, "!!! 123 ???") not in first
    own = [(r["doc_id"], r["text"]) for r in kept["language_id"]]
    roots = linked(own, 80)
    assert Counter(r["doc_id"] for r in kept["near_dedup"]) == Counter([i for i in set(roots) if roots[i] == i] + [i for i, _ in own if i is None])
    own = [(r["doc_id"], r["text"]) for r in kept["near_dedup"]]
    made = Counter((r["doc_id"], hashlib.sha256(b" ".join(words(r["text"]))).hexdigest(), r["n_chars"]) for r in kept["substring_dedup"])
    assert {(i, h) for i, h, _ in made} == {(i, h) for i, _, _, h in windows_removed(own, 35)} and all(r["n_chars"] == len(r["text"]) for r in kept["substring_dedup"])
    assert {r["doc_id"] for r in kept["packing"]} == {r["doc_id"] for r in kept["substring_dedup"]}
    assert pipeline.run(spark, str(tmp_path)).count() == len(kept["packing"])
