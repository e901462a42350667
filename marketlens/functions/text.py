"""Text expressions, all JVM-side (no Python UDF)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the whitespace set trimmed by the review-text strip.
WHITESPACE = "[ \\t\\n\\r\\f]"


def strip(c: Column) -> Column:
    """Trim leading/trailing whitespace (not just spaces, unlike ``trim``)."""
    return F.regexp_replace(c, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


# The Portuguese stopword list of the modelled sentiment
# cleaner (default; callers pass their own list for other languages).
PT_STOPWORDS = tuple("""
a ao aos aquela aquelas aquele aqueles aquilo as até com como da das de dela
delas dele deles depois do dos e ela elas ele eles em entre era eram essa
essas esse esses esta estas este estes eu foi fomos for foram fui há isso
isto já lhe lhes mais mas me mesmo meu meus minha minhas muito na nas nem no
nos nossa nossas nosso nossos num numa não nós o os ou para pela pelas pelo
pelos por qual quando que quem se seu seus somos sua suas são só também te
tem temos teu teus tu tua tuas um uma você vocês vos à às
""".split())

# Patterns removed by the cleaner, in order.
TAG_PATTERN = "<.*?>"
URL_PATTERN = "http\\S+"
ASCII_PUNCT_CLASS = "[!-/:-@\\[-`{-~]"      # Python's string.punctuation
DIGITS_PATTERN = "[0-9]+"
PUNCT_OR_DIGITS = ASCII_PUNCT_CLASS[:-1] + "0-9]+"     # both character classes in one pass


def clean_tokens(c: Column, stopwords=PT_STOPWORDS) -> Column:
    """Lower-case, strip tags, URLs, ASCII punctuation and digits, split
    on whitespace, drop stopwords and 1-character tokens -> array<string>."""
    t = F.lower(c)
    t = F.regexp_replace(t, TAG_PATTERN, "")
    t = F.regexp_replace(t, URL_PATTERN, "")
    t = F.regexp_replace(t, PUNCT_OR_DIGITS, "")
    toks = F.split(t, f"{WHITESPACE}+")
    return F.filter(toks, lambda w: (F.length(w) > 1) & ~w.isin(*(stopwords or ())))


def clean_text(c: Column, stopwords=PT_STOPWORDS) -> Column:
    return F.array_join(clean_tokens(F.coalesce(c, F.lit("")), stopwords), " ")


def bigrams(tokens: Column) -> Column:
    """Adjacent token pairs ``"w1 w2"`` of an array column."""
    n = F.size(tokens)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n - 1),
                    lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1))))
