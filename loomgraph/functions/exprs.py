"""Scalar functions as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def make_id(*parts: Column) -> Column:
    """Parts joined by "_"; runs of anything but ASCII letters and digits become one "_", none at the ends; lower case."""
    return F.lower(F.btrim(F.regexp_replace(F.concat_ws("_", *parts), "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def file_category(path: Column) -> Column:
    """code, paper, image or doc, by extension."""
    ext = extension(path)
    return F.when(ext.isin(*fixed.CATEGORY_CODE), "code").when(ext.isin(*fixed.CATEGORY_PAPER), "paper").when(ext.isin(*fixed.CATEGORY_IMAGE), "image").otherwise("doc")


def top_level_dir(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def second_level_dir(path: Column) -> Column:
    """First component that isn't a usual top directory, if it isn't the last; else the one above the file; else empty."""
    parts = F.split(path, "/")
    own = F.filter(parts, lambda p: ~p.isin(*fixed.TOP_DIRS))
    first = F.get(own, F.lit(0))
    # The first such component is the last one only if all before it are top directories.
    is_last = F.size(F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.isin(*fixed.TOP_DIRS))) == 0
    above = F.when(F.size(parts) >= 2, F.element_at(parts, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise("")
    return F.when(path == "", "").when(first.isNull() | is_last, above).otherwise(first)


def is_non_source(path: Column) -> Column:
    """Tests, benchmarks, examples, platform code and generated files."""
    low = F.lower(path)
    dirs = "|".join(("test", "benchmark", "example"))
    ends = "|".join(re.escape(e) for e in fixed.PLATFORM_FILES)
    return low.rlike(f"(^|/)({dirs})/|({ends})$|generated|runner/")


def glob_regex(glob: str) -> str:
    """A shell glob as an anchored regular expression: * and ? don't match "/"."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out += "[" + glob[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def is_sensitive(path: Column) -> Column:
    return basename(path).rlike("|".join(glob_regex(g) for g in fixed.SENSITIVE_NAMES))


def is_hidden(path: Column) -> Column:
    """Whether a component of a path relative to the root begins with a dot."""
    return path.rlike(r"(^|/)\.")


def in_noise_dir(path: Column) -> Column:
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, fixed.NOISE_DIRS)))


def in_asset_dir(path: Column) -> Column:
    ends = "|".join(re.escape(e) for e in fixed.ASSET_DIRS)
    return path.rlike(f"({ends})([/\\\\]|$)")


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path matches an ignore pattern: its name, itself, or a directory on the way."""
    tests = [F.lit(False)]
    for p in (p[:-1] if p.endswith("/") else p for p in patterns):
        tests += [basename(path).rlike(glob_regex(p)), path.rlike(glob_regex(p)), F.contains(path, F.lit(f"/{p}/")), F.startswith(path, F.lit(f"{p}/"))]
    return _any(tests)


def is_under(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or inside one."""
    return _any([F.lit(False), *[(path == r) | F.startswith(path, F.lit(f"{r}/")) for r in roots]])


def word_count(text: Column) -> Column:
    """Words between Unicode white space; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), F.lit(0))


def paper_score(text: Column) -> Column:
    """Signs of a paper in the first bytes of a text."""
    head = F.coalesce(F.substring(text.cast("binary"), 1, fixed.PAPER_BYTES).cast("string"), F.lit(""))
    hits = [F.contains(F.lower(head), F.lit(s)).cast("int") for s in fixed.PAPER_SIGNALS]
    cited = _any([F.contains(head, F.lit(c)) for c in fixed.CITATIONS]).cast("int")
    return reduce(lambda a, b: a + b, [*hits, cited])


def classify(path: Column, paper: Column, more: bool = False) -> Column:
    """code, document, paper, image, video, or null; paper: whether a document reads like one."""
    ext = extension(path)
    code = fixed.CODE_FILES + (fixed.MORE_CODE_FILES if more else ())
    return (
        F.when(in_asset_dir(path), None)
        .when(ext.isin(*code), "code")
        .when(ext.isin(*fixed.PAPER_FILES), "paper")
        .when(ext.isin(*fixed.IMAGE_FILES), "image")
        .when(ext.isin(*fixed.DOCUMENT_FILES), F.when(paper, "paper").otherwise("document"))
        .when(ext.isin(*fixed.MEDIA_FILES), "video")
    )


def body(text: Column) -> Column:
    """A Markdown text without its front matter (what stands between two lines of three dashes at the top)."""
    rest = F.substring(text, 5, 2147483647)
    at = F.instr(rest, "\n---")
    return F.when(F.startswith(text, F.lit("---")) & (at > 0), F.substring(rest, at + 4, F.length(rest))).otherwise(text)


def content_hash(path: Column, text: Column) -> Column:
    """SHA-256 of a file's bytes; of a Markdown file, of its body."""
    return F.sha2(F.when(extension(path) == ".md", body(text)).otherwise(text).cast("binary"), 256)


def method_name(label: Column) -> Column:
    """A label without the dot before and the parentheses behind."""
    return F.regexp_replace(F.regexp_replace(label, r"^\.", ""), r"\(\)$", "")


def label_score(label: Column, kind: Column, degree: Column) -> Column:
    """How good a label names a community."""
    points = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), list(fixed.LABEL_POINTS.items())[1:], F.when(kind == "class", fixed.LABEL_POINTS["class"])).otherwise(0)
    helper = _any([F.startswith(label, F.lit(p)) for p in fixed.HELPER_PREFIXES])
    score = degree + points - F.when(label == "main()", 200).otherwise(0) - F.when(helper, 80).otherwise(0) - F.when(F.startswith(label, F.lit("_")), 20).otherwise(0)
    return F.when(kind == "module", -1).otherwise(score).cast("long")


def terms(question: Column) -> Column:
    """Lower-case words of a question of more than two bytes that aren't stopwords."""
    return F.filter(F.split(F.lower(question), r"(?U)\s+"), lambda w: (F.octet_length(w) > 2) & ~w.isin(*fixed.STOPWORDS))


def match_score(label: Column, wanted: Column) -> Column:
    """5 for each term that is the label, else 2 for each that it contains; case doesn't count."""
    low = F.lower(label)
    return F.aggregate(wanted, F.lit(0).cast("long"), lambda s, t: s + F.when(low == F.lower(t), 5).when(F.contains(low, t), 2).otherwise(0).cast("long"))


def is_file_node(label: Column, kind: Column, file: Column) -> Column:
    return (kind == "file") | ((file != "") & (label == basename(file)))


def is_concept(kind: Column, file: Column) -> Column:
    return (kind == "module") | (file == "")


def safe_name(label: Column) -> Column:
    """A label that can name a file."""
    name = F.regexp_replace(F.regexp_replace(label, r'[\[\]\\/*?:"<>|#^]', ""), "\r\n|\r|\n", " ")
    name = F.btrim(F.regexp_replace(name, r"\.(md|mdx|markdown)$", ""))
    return F.when(name == "", "unnamed").otherwise(name)


def truncated(names: Column, most: int) -> Column:
    """The first names of an array, and how many more there are."""
    more = F.concat(F.lit("(+"), (F.size(names) - most).cast("string"), F.lit(" more)"))
    return F.when(F.size(names) <= most, names).otherwise(F.concat(F.slice(names, 1, most), F.array(more)))
