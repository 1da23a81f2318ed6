import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import exprs
from loomgraph.operators.traverse import question_terms
from loomgraph.sources.extract.base import make_id


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


IDS = {"_auth": "auth", ".httpx._client": "httpx_client", "A b-C": "a_b_c", "éé": "", "": "", "__x__": "x"}


def test_make_id(spark):
    assert column(spark, list(IDS), exprs.make_id) == list(IDS.values())
    assert [make_id(x) for x in IDS] == list(IDS.values())


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_make_id_is_idempotent(text):
    assert make_id(make_id(text)) == make_id(text)


def test_categories(spark):
    want = {"a.py": "code", "b.go": "code", "c.R": "code", "d.pdf": "paper", "e.md": "paper", "f.png": "image", "g.dart": "doc", "h.txt": "doc", "i": "doc", "x/.py/y": "doc"}
    assert column(spark, list(want), exprs.file_category) == list(want.values())


def test_second_level_dir(spark):
    want = {"lib/src/widgets/b.dart": "widgets", "src/models/u.go": "models", "lib/b.dart": "lib", "main.go": "", "": "", "tool/x.go": "tool", "lib/src": "lib"}
    assert column(spark, list(want), exprs.second_level_dir) == list(want.values())


def test_non_source(spark):
    want = {"test/a.py": True, "x/test/a.py": True, "latest/a.py": False, "a.h": True, "a.hs": False, "gen/x_generated.dart": True, "ios/Runner/a.py": True}
    assert column(spark, list(want), exprs.is_non_source) == list(want.values())


def test_sensitive_and_ignored(spark):
    want = {"a/.env": True, "a/token_store.py": True, "id_rsa": True, "id_rsa.pub": False, "a/main.py": False, "Secret.txt": False}
    assert column(spark, list(want), exprs.is_sensitive) == list(want.values())
    paths = {"a/b.py": True, "x/a.log": True, "a": True, "b/x.py": False, "q/gen/x.py": True}
    assert column(spark, list(paths), lambda c: exprs.is_ignored(c, ["a/", "*.log", "gen"])) == list(paths.values())


@pytest.mark.parametrize(("glob", "name", "hit"), [("*.py", "a.py", True), ("*.py", "a/b.py", False), ("a?c", "abc", True), ("[ab]x", "bx", True), ("a.c", "abc", False), ("", "", True)])
def test_globs(glob, name, hit):
    import re

    assert bool(re.search(exprs.glob_regex(glob), name)) == hit


def test_words_papers_and_bodies(spark):
    assert column(spark, ["a b", "", "  x y　z ", None], exprs.word_count) == [2, 0, 3, 0]
    assert column(spark, ["Abstract [1] arXiv", "plain", None, "x" * 3000 + "abstract"], exprs.paper_score) == [3, 0, 0, 0]
    assert column(spark, ["---\na: b\n---\nrest", "---", "x", "---\nopen"], exprs.body) == ["\nrest", "---", "x", "---\nopen"]


def test_labels_and_terms(spark):
    rows = spark.createDataFrame([("main()", "function", 3), ("Foo", "class", 2), ("m", "module", 9), ("_make_x()", "method", 1)], "l string, t string, d long")
    assert [r[0] for r in rows.select(exprs.label_score(F.col("l"), F.col("t"), F.col("d"))).collect()] == [-147, 102, -1, -69]
    q = "How does the Auth work? é in ab"
    assert question_terms(q) == ["auth", "work?"] and column(spark, [q], exprs.terms) == [["auth", "work?"]]
    score = lambda c: exprs.match_score(c, F.array(F.lit("auth"), F.lit("work")))
    assert column(spark, ["Auth", "AuthWork", "x"], score) == [5, 4, 0]


def test_safe_names_and_classes(spark):
    want = {"a/b:c": "abc", "x.md": "x", "": "unnamed", "a\nb": "a b"}
    assert column(spark, list(want), exprs.safe_name) == list(want.values())
    kinds = {"a.py": "code", "A.xcassets/a.png": None, "a.mp3": "video", "a.md": "document", "a.pdf": "paper", "a.xyz": None, "a.r": None}
    assert column(spark, list(kinds), lambda c: exprs.classify(c, F.lit(False))) == list(kinds.values())
    assert column(spark, ["a.r"], lambda c: exprs.classify(c, F.lit(False), more=True)) == ["code"]
