r"""Personal data: patterns propose, checksums confirm, context adjusts.

Kinds, in order: ``email``, ``ip`` (four parts, each at most 255), ``card``
(14 to 19 digits passing Luhn), ``phone`` (10 to 15 digits), ``iban`` (two
letters, two digits and 11 to 30 more characters, passing mod 97) and
``national`` (3-2-4 digits).  Each proposal has a score: a base score of its
kind, plus ``CONTEXT_GAIN`` if one of the kind's context words stands within
``CONTEXT`` code points before it, at most 1.  The first four kinds are always
kept; ``iban`` and ``national`` need ``THRESHOLD``, which ``national`` reaches
by its context only.

DataFrame functions only, one pass, no shuffle.  Patterns are anchored to the
start of a run (or the end of the previous match) and use possessive loops, so
a run of any length is read once and without recursion; they match exactly
what the plain patterns match.

Defined cases: null texts count as empty; texts without a match have empty
spans and the hash of the empty string; matches of different kinds may
overlap; equal rows give equal results.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import text_or_empty
from marketlens.llm.spans import between, blocks, in_order, let, replaced, with_spans, written

CONTEXT = 40
CONTEXT_GAIN = 0.35
THRESHOLD = 0.8
_LOCAL = "A-Za-z0-9._%+-"
_NAME = "A-Za-z0-9-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_NAME}]++(?:\.[{_NAME}]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Base score and context words of each kind.
KINDS: dict[str, tuple[float, str]] = {
    "email": (0.9, "mail|contact|write to|kontakt|correo"),
    "ip": (0.6, r"\bip\b|address|host|server|adresse"),
    "card": (0.7, "card|visa|payment|karte|carte|tarjeta"),
    "phone": (0.6, "phone|call|mobile|tel|fax"),
    "iban": (0.9, "iban|account|bank|konto|compte|cuenta"),
    "national": (0.5, "ssn|social security|national id"),
}
BASE = ("email", "ip", "card", "phone")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    doubled = F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(F.element_at(doubled, c.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an account number (letters and digits only) passes mod 97."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(
        c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _card_ok(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))


def _ip_ok(m: Column) -> Column:
    # leading zeros do not change a part's value; a part of more than three other digits is above 255
    part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, r"\."), lambda x: F.when(
        F.length(part(x)) <= 3, part(x).cast("int") <= 255).otherwise(F.lit(False)))


def _iban_ok(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    return F.length(plain).between(15, 34) & mod97(plain)


def scan(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``base`` (spans of the first four kinds) and ``all_spans`` (all
    kept spans), both in order, with a ``score`` in ``all_spans``."""
    t = F.col(text)
    digit = t.rlike("[0-9]")
    df = docs.withColumn("_digit", digit)
    rules = {
        "email": (EMAIL, t.contains("@"), None),
        "ip": (IP, F.col("_digit") & t.rlike(r"[0-9]\.[0-9]"), _ip_ok),
        "card": (CARD, F.col("_digit") & t.rlike(r"[0-9][\x20-]?[0-9]"), _card_ok),
        "phone": (PHONE, F.col("_digit") & t.contains("+"), lambda m: F.length(_digits(m)).between(10, 15)),
        "iban": (IBAN, F.col("_digit") & t.rlike(r"[A-Z]{2}[0-9]{2}"), _iban_ok),
        "national": (NATIONAL, F.col("_digit") & t.rlike("[0-9]-[0-9]{2}-[0-9]"), None),
    }
    for place, (kind, (pattern, test, keep)) in enumerate(rules.items()):
        df = with_spans(df, f"_{kind}", text, pattern, kind, place, test, keep)
    df = df.withColumn("base", in_order(*[f"_{k}" for k in BASE]))

    def scored(s: Column, cut: Column) -> Column:
        before = F.lower(between(cut, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"]))
        near, base = F.lit(False), F.lit(0.0)
        for kind, (points, context) in KINDS.items():
            near = F.when(s["kind"] == kind, before.rlike(context)).otherwise(near)
            base = F.when(s["kind"] == kind, F.lit(points)).otherwise(base)
        return F.least(F.lit(1.0), base + F.when(near, F.lit(CONTEXT_GAIN)).otherwise(0.0))

    every = let(blocks(t), lambda cut: F.transform(in_order(*[f"_{k}" for k in rules]), lambda s: F.struct(
        s["start"].alias("start"), s["place"].alias("place"), s["kind"].alias("kind"), s["stop"].alias("stop"),
        s["found"].alias("found"), F.round(scored(s, cut), 2).alias("score"))))
    df = df.withColumn("_every", F.when(F.size("base") + F.size("_iban") + F.size("_national") > 0, every))
    df = df.withColumn("all_spans", F.coalesce(F.filter(
        "_every", lambda s: (s["place"] < len(BASE)) | (s["score"] >= THRESHOLD)),
        F.filter(every, lambda s: F.lit(False))))
    return df.drop("_digit", "_every", *[f"_{k}" for k in rules])


def find(docs: DataFrame) -> DataFrame:
    """Digest of the personal data of every document."""
    found = scan(docs.select("doc_id", text_or_empty().alias("_text")), "_text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.col("all_spans")).alias("spans"),
                        F.transform("all_spans", lambda s: s["score"]).alias("scores"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every kept span replaced by ``[KIND]``; null texts stay."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_or_empty().alias("_text"))
    clean = replaced("_text", F.col("all_spans"), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rows = scan(rows, "_text").withColumn("_clean", F.when(F.col("row.text").isNotNull(), clean))
    return rows.select(*[F.col("_clean").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])
