"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to 3 with escape counts
(method C): in a context seen ``n`` times with ``u`` different successors, a
successor seen ``c`` times has probability ``c / (n + u)``, and ``u / (n + u)``
goes to the next shorter context, down to 1/256 for any byte.  Statistics are
frozen after training, so the code length of a byte depends on its context
only.  A text's code length under a language is the exact sum over all its
bytes; the shortest wins.  ``score`` is the winner's posterior with equal
priors, ``1 / sum(2 ** (best - length))``.

Training takes at most ``SAMPLE_DOCS`` labelled documents of each language
(those with the smallest id hashes), whole; scoring reads every text whole, in
windows of ``WINDOW`` bytes.  The driver builds the tables (states x symbols x
languages x 4 bytes, some tens of MB) once and broadcasts them; a task holds
them and one window besides its Arrow batch.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
with no labelled rows everything is ``und``; equal code lengths go to the
language that comes first by code point; rows without an id are never used
for training.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import id_crc, lean_map, sample_ids, sample_rows, sum_rows, utf8_buffer

SAMPLE_DOCS = 300
WINDOW = 1 << 19
ORDER = 3
UNDECIDED = "und"
RATE_SHARE = 0.999
RATE_MARGIN = 1.25


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each byte with the three before it, by language, over whole
    texts.  A byte is its value plus one, 0 the start of the text."""
    for b in batches:
        data, offsets = utf8_buffer(b.column("text"))
        langs, codes, times = [], [], []
        for lang, lo, hi in zip(b.column("lang").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            line = np.concatenate((np.zeros(ORDER, np.int64), data[lo:hi].astype(np.int64) + 1))
            code = np.zeros(hi - lo, np.int64)
            for k in range(ORDER + 1):
                code = code * 257 + line[k:len(line) - ORDER + k]
            code, n = np.unique(code, return_counts=True)
            langs += [lang] * len(code)
            codes.append(code)
            times.append(n)
        if codes:
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(codes)),
                                              pa.array(np.concatenate(times), pa.int64())], ["lang", "code", "n"])


def _counts(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict:
    """Symbol map and, by language and order, context-and-successor counts,
    from the counts of the highest order."""
    seen = np.zeros(257, bool)
    digits = {}
    for lang, (code, _) in grams.items():
        digits[lang] = [code // 257 ** (ORDER - k) % 257 for k in range(ORDER + 1)]
        for d in digits[lang]:
            seen[d] = True
    seen[0] = False
    a = int(seen.sum()) + 2
    symbols = np.full(257, a - 1, np.int64)     # the last symbol is any unseen byte, 0 the start of a text
    symbols[seen] = np.arange(1, a - 1)
    symbols[0] = 0
    out: dict[str, list] = {}
    for lang, (_, times) in grams.items():
        line = [symbols[d] for d in digits[lang]]
        own = []
        for k in range(ORDER + 1):
            code = np.zeros(len(times), np.int64)
            for j in range(k, -1, -1):
                code = code * a + line[ORDER - j]
            codes, at = np.unique(code, return_inverse=True)
            own.append((codes, np.bincount(at, times, len(codes)).astype(np.int64)))
        out[lang] = own
    return {"a": a, "symbols": symbols[1:], "langs": list(grams), "grams": out}


def _build(model: dict) -> tuple:
    """``(symbols, a, state of each 3-symbol context, code length[state * a + symbol, language])``."""
    a, langs = model["a"], model["langs"]
    count = lambda lang, k: model["grams"][lang][k]
    contexts = [np.unique(np.concatenate([count(lang, k)[0] // a for lang in langs])) for k in range(ORDER + 1)]
    base = np.cumsum([0] + [len(c) for c in contexts])
    cost = np.empty((base[-1], a, len(langs)), np.float32)
    below = np.full((1, a, len(langs)), 8.0, np.float32)
    for k in range(ORDER + 1):
        own = contexts[k]
        if k:                                   # a shorter context of a seen context has been seen as well
            parent = base[k - 1] + np.searchsorted(contexts[k - 1], own % a ** (k - 1))
            rows = cost[parent]
        else:
            rows = np.repeat(below, len(own), axis=0)
        for j, lang in enumerate(langs):
            codes, times = count(lang, k)
            at = np.searchsorted(own, codes // a)
            n = np.bincount(at, times, len(own))
            u = np.bincount(at, minlength=len(own))
            known = n > 0
            rows[known, :, j] -= np.log2(u[known] / (n + u)[known])[:, None].astype(np.float32)
            rows[at, codes % a, j] = -np.log2(times / (n + u)[at])
        cost[base[k]:base[k + 1]] = rows
    state = np.zeros(a ** ORDER, np.int32)
    every = np.arange(a ** ORDER)
    for k in range(1, ORDER + 1):
        short = every % a ** k
        at = np.minimum(np.searchsorted(contexts[k], short), len(contexts[k]) - 1)
        hit = contexts[k][at] == short
        state[hit] = base[k] + at[hit]
    return model["symbols"], a, state, cost.reshape(-1, len(langs))


def code_lengths(data: np.ndarray, offsets: np.ndarray, tables: tuple) -> np.ndarray:
    """Bits of each row under each language."""
    symbols, a, state, cost = tables
    bits = np.zeros((len(offsets) - 1, cost.shape[1]))
    begin, end = int(offsets[0]), int(offsets[-1])
    for start in range(begin, end, WINDOW):
        stop = min(end, start + WINDOW)
        lead = max(begin, start - ORDER)
        sym = symbols[data[lead:stop]]
        heads = offsets[np.searchsorted(offsets, lead):np.searchsorted(offsets, stop, "right")] - lead
        skip = start - lead
        context = np.zeros(stop - start, np.int64)
        for back in range(ORDER, 0, -1):        # oldest symbol first
            past = np.zeros(len(sym), np.int64)
            past[back:] = sym[:-back]
            for d in range(back):               # nothing is known of what lies before a text
                past[heads[heads + d < len(sym)] + d] = 0
            context = context * a + past[skip:]
        sum_rows(cost[state[context].astype(np.int64) * a + sym[skip:]], offsets, start, bits)
    return bits


def fit(texts: dict[str, list[str]]) -> dict:
    """Model of labelled texts by language."""
    rows = pa.RecordBatch.from_pylist([{"lang": lang, "text": t} for lang in sorted(texts) for t in texts[lang]],
                                      pa.schema([("lang", pa.string()), ("text", pa.string())]))
    return _fitted([(r["lang"], r["code"], r["n"]) for b in _grams(iter([rows])) for r in b.to_pylist()])


def _fitted(rows: list[tuple[str, int, int]]) -> dict:
    """Finished tables from ``(language, code, times)`` rows."""
    total: dict[str, dict[int, int]] = {}
    for lang, code, n in rows:
        own = total.setdefault(lang, {})
        own[code] = own.get(code, 0) + n
    counts = _counts({lang: (np.array(list(own), np.int64), np.array(list(own.values()), np.int64))
                      for lang, own in sorted(total.items())})
    return {"langs": counts["langs"], "tables": _build(counts)}


def predict(docs: DataFrame, model: dict | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` and ``rate`` (bits a byte
    under the predicted language; 0 for empty texts) of every row of ``docs``.
    ``text`` may be a field of a kept struct (``row.text``), which then travels
    once."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    whole, _, part = text.partition(".")
    inside = part and whole in keep
    rows = docs.select(*[F.col(c) for c in keep], *([] if inside else [F.col(text).alias("_text")]),
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    if not model or not model["langs"]:
        return rows.select(*keep, F.lit(UNDECIDED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("rate"))
    sent = docs.sparkSession.sparkContext.broadcast(model)      # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array(m["langs"], object)
        for b in batches:
            column = pc.struct_field(b.column(whole), part) if inside else b.column("_text")
            data, offsets = utf8_buffer(column)
            bits = code_lengths(data, offsets, m["tables"])
            best, least = bits.argmin(axis=1), bits.min(axis=1)
            score = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            known = b.column("_letters").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(np.where(known, names[best], UNDECIDED), pa.string()),
                                               pa.array(np.where(known, score, 0.0)),
                                               pa.array(least / np.maximum(np.diff(offsets), 1))],
                [*keep, "lang_pred", "score", "rate"])

    return lean_map(rows, run, f"{schema}, lang_pred string, score double, rate double")


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", lang_col: str = "lang") -> dict | None:
    """Model of the labelled documents for which ``usable`` holds.  The
    sampled texts are counted whole on the executors; the driver gets one row
    per language and distinct run of four bytes."""
    labelled = docs.where(usable).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    rows = sample_rows(docs.where(usable).select(F.col(id_col).alias("doc_id"), "text"), sample_ids(labelled, "lang", SAMPLE_DOCS))
    grams = lean_map(rows.select("lang", "text"), _grams, "lang string, code long, n long") \
        .groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    return _fitted(list(zip(*(grams.column(c).to_pylist() for c in ("lang", "code", "n"))))) if len(grams) else None


def rate_limits(labelled: DataFrame) -> DataFrame:
    """``limit_lang, rate_limit``: how many bits a byte a text of a language may
    take, from ``lang, rate`` of all labelled texts: ``RATE_MARGIN`` times
    their ``RATE_SHARE`` quantile.  Texts in no learned language (random
    letters, program code, another alphabet) take about twice as many."""
    rate = F.percentile_approx("rate", RATE_SHARE, 10_000) * RATE_MARGIN
    return labelled.where(F.col("lang").isNotNull()).groupBy(F.col("lang").alias("limit_lang")).agg(rate.alias("rate_limit"))


def held_out() -> Column:
    return id_crc() % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; the model is
    learned from the text and language of the documents not held out."""
    model = train(docs, ~held_out())
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, ["doc_id", "held_out"]).drop("rate")
