r"""Secrets: patterns, then corpus-wide ownership frequency.

Base kinds, in order: ``assign`` (a key word, a separator and a value of 6 or
more characters), ``access`` (``AKIA`` and at least 16 more characters) and
``hex`` (24 or more hexadecimal digits).  The method proposes one more kind,
``token``: runs of 32 or more characters that mix capitals, small letters and
digits.

The secret part of each candidate is hashed (texts never leave the scan).  For
each hash the corpus is asked in how many distinct repositories (document ids)
and how many owners (sources) it occurs.  A value of ``EXAMPLE_OWNERS`` or more
owners, or of ``EXAMPLE_REPOS`` or more repositories even of one owner, is a
widely copied example; another value of one owner is live-looking; the rest is
shared.  Base spans always stay; ``token`` spans are added only where they are
live-looking.

DataFrame functions only.  The texts are read once; the small table of
candidates is written, counted by hash with partial sums (a hash that a third
of all rows share is one row for each task and owner before the shuffle) and
joined back by hash, where the adaptive join splits hot hashes.

Defined cases: null texts count as empty; the null source is an owner of its
own; a value repeated within one row counts once for it; rows of one id are
one repository, and rows without an id are one together; an empty table gives
no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import text_or_empty
from marketlens.llm.spans import in_order, with_spans, written
from marketlens.sources.store import materialize

EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 20
BASE = ("assign", "access", "hex")
_WORDS = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = _WORDS + r"""["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_HEAD = "^" + _WORDS + r"""["']?\x20*+[:=]\x20*+["']?"""
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*?[A-Z])(?=[A-Za-z0-9+/_-]*?[a-z])(?=[A-Za-z0-9+/_-]*?[0-9])"
         r"[A-Za-z0-9+/_-]{32,}+")


def _value(kind: Column, found: Column) -> Column:
    return F.when(kind == "assign", F.regexp_replace(found, ASSIGN_HEAD, "")).otherwise(found)


def _candidates(docs: DataFrame) -> DataFrame:
    """Per row: its spans (without texts) and the hashes of their values."""
    df = docs.select("doc_id", "source", text_or_empty().alias("_text"))
    t = F.col("_text")
    six = lambda m: F.length(F.regexp_replace(m, ASSIGN_HEAD, "")) >= 6
    rules = {
        "assign": (ASSIGN, t.rlike(ASSIGN), six),
        "access": (ACCESS, t.contains("AKIA"), None),
        "hex": (HEX, t.rlike("[0-9a-f]{24}"), None),
        "token": (TOKEN, t.rlike("[A-Za-z0-9+/_-]{32}"), None),
    }
    for place, (kind, (pattern, test, keep)) in enumerate(rules.items()):
        df = with_spans(df, f"_{kind}", "_text", pattern, kind, place, test, keep)
    marks = F.transform(in_order(*[f"_{k}" for k in rules]), lambda s: F.struct(
        s["start"].alias("start"), s["place"].alias("place"), s["kind"].alias("kind"), s["stop"].alias("stop"),
        F.sha2(_value(s["kind"], s["found"]), 256).alias("hash")))
    return df.select("doc_id", "source", F.xxhash64("_text").alias("body"), marks.alias("marks"))


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, n_repos, n_owners, class`` over the whole corpus."""
    each = candidates.select("doc_id", "source", F.explode(F.array_distinct(F.transform("marks", lambda m: m["hash"]))).alias("hash"))
    repos = each.select("hash", "doc_id").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"))
    owners = each.select("hash", "source").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    wide = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOS)
    return repos.join(owners, "hash").withColumn("class", F.when(wide, "example").when(
        F.col("n_owners") == 1, "live").otherwise("shared"))


def find(docs: DataFrame) -> DataFrame:
    """Digest of the secrets of every document, with ownership classes."""
    rows = materialize(docs.sparkSession, _candidates(docs), "secrets")
    known = ownership(rows)
    # one row per distinct (id, text) and hash; equal rows share their answer
    uses = rows.where(F.size("marks") > 0).select("doc_id", "body", F.explode(F.array_distinct(
        F.transform("marks", lambda m: m["hash"]))).alias("hash")).distinct()
    kinds = uses.join(known, "hash").groupBy("doc_id", "body").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("hash"), F.col("class")))).alias("classes"))
    kinds = kinds.withColumnsRenamed({"doc_id": "_id", "body": "_body"})
    seen = rows.join(kinds, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")), "left")
    kind_of = lambda m: F.col("classes")[m["hash"]]
    base = F.filter("marks", lambda m: m["place"] < len(BASE))
    every = F.filter("marks", lambda m: (m["place"] < len(BASE)) | (kind_of(m) == "live"))
    count = lambda kind: F.size(F.filter("marks", lambda m: m["kind"] == kind)).cast("long")
    return seen.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(base), 256).alias("base_sha256"), written(every).alias("spans"),
        F.size(F.filter(every, lambda m: kind_of(m) == "live")).cast("long").alias("n_live"),
        F.size(F.filter(every, lambda m: kind_of(m) == "example")).cast("long").alias("n_example"),
        F.array_join(F.transform(every, kind_of), ",").alias("classes"))
