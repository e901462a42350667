"""Spans of regular expressions as DataFrame expressions.

Offsets are in code points, ends exclusive.  ``split`` gives the pieces between
the matches of a pattern and ``regexp_extract_all`` the matches themselves, so
their running lengths are the offsets; both run only on texts that pass a
cheap test first.

Work grows with the text plus ``n log n`` in its ``n`` matches: running sums
are taken by doubling distances, and what lies around a match is read from the
text cut into blocks once, not from the start of the text each time.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,place:int,kind:string,stop:bigint,found:string>"
BLOCK = 64


def running(values: Column, join) -> Column:
    """Running ``join`` (sum, maximum) of an array of numbers, the own element
    included: element i takes in i-1, then i-2, i-4 and so on."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1)

    def step(acc: Column, s: Column) -> Column:
        back = F.pow(F.lit(2), s).cast("int")
        return F.transform(acc, lambda x, i: F.coalesce(join(x, F.get(acc, i - back)), x))

    return F.aggregate(steps, values, step)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` reads it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(text: Column) -> Column:
    """The text cut into blocks of ``BLOCK`` code points."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def between(cut: Column, start: Column, stop: Column) -> Column:
    """Code points ``start`` (from 0) to ``stop`` (exclusive) of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(cut, first + 1, F.ceil(stop / BLOCK).cast("int") - first)
    return F.when(stop > start, F.substr(F.array_join(some, ""), (start - first * BLOCK + 1).cast("int"),
                                         (stop - start).cast("int"))).otherwise("")


def with_spans(df: DataFrame, out: str, text: str, pattern: str, kind: str, place: int,
               test: Column, keep=None) -> DataFrame:
    """Adds ``out``: the leftmost non-overlapping matches of ``pattern`` as an
    array of ``SPAN``; ``keep(match)`` drops matches (without another try)."""
    none = F.array().cast("array<string>")
    possible = F.coalesce(test, F.lit(False))
    df = df.withColumn(f"{out}_m", F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(f"{out}_p", F.when(F.size(f"{out}_m") > 0, F.split(text, pattern, -1)).otherwise(none))
    # the piece after the last match has no match beside it
    lengths = F.zip_with(f"{out}_p", f"{out}_m", lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("bigint"))
    spans = F.zip_with(f"{out}_m", running(lengths, lambda a, b: a + b), lambda m, stop: F.struct(
        (stop - F.length(m)).alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"),
        stop.alias("stop"), m.alias("found")))
    good = F.filter(spans, lambda s: s["found"].isNotNull() & (keep(s["found"]) if keep else F.lit(True)))
    return df.withColumn(out, F.when(F.size(f"{out}_m") > 0, good.cast(f"array<{SPAN}>"))
                         .otherwise(F.array().cast(f"array<{SPAN}>"))).drop(f"{out}_m", f"{out}_p")


def in_order(*lists: str) -> Column:
    """All spans by start, then kind as listed."""
    return F.array_sort(F.concat(*lists))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def replaced(text: str, spans: Column, with_) -> Column:
    """The text with every span replaced by ``with_(span)``; a span that begins
    inside an earlier one only extends it."""
    def parts(cut: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["stop"]), F.greatest)

        def each(ends: Column) -> Column:
            before = F.transform(spans, lambda s, i: let(F.coalesce(F.get(ends, i - 1), F.lit(0).cast("bigint")), lambda at: F.when(
                s["start"] >= at, F.concat(between(cut, at, s["start"]), with_(s))).otherwise("")))
            last = F.element_at(ends, -1)
            return F.concat(F.array_join(before, ""), between(cut, last, F.size(cut).cast("bigint") * BLOCK))

        return let(reach, each)

    return F.when(F.size(spans) > 0, let(blocks(F.col(text)), parts)).otherwise(F.col(text))
