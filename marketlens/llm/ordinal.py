"""Toxicity severity by cumulative-link ordinal regression.

Grades ``0 < 1 < ... < K`` share one weight vector over sparse text features
and differ by ordered thresholds: ``P(grade <= j) = sigmoid(threshold_j - w.x)``.
Features are the presence of lower-cased words (runs of letters), each scaled
by how far its smoothed rate differs between the lowest grade and the others,
so that words seen everywhere carry little.  The output is the distribution
over grades, its mean (expected severity) and the likeliest grade.

Training takes at most ``SAMPLE_DOCS`` labelled rows of each grade (smallest
id hashes) and weighs them back to the grades' shares among all labelled rows.
Their words are gathered from whole texts on the executors; the driver gets
each row's distinct words.  Scoring reads every text whole.

Defined cases: null and empty texts have no features and are scored by the
thresholds alone; with no labelled rows, or one grade only, the severity is
the lowest grade seen (0 if none); labels without a document and labels that
are null are ignored; several labels of one id count as the smallest.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import lean_map, sample_ids, sample_rows

SAMPLE_DOCS = 4000
MIN_DOCS = 3
ROUNDS = 200
L2 = 1e-3
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit(texts: list[str], grades: list[int], shares: dict[int, float]) -> dict:
    return fit_words((sorted(words(t)) for t in texts), grades, shares)


def fit_words(texts: Iterable[list[str]], grades: list[int], shares: dict[int, float]) -> dict:
    """Weights by word and increasing thresholds, from the distinct words of
    each text.  ``shares`` are the grades' shares among all labelled rows."""
    levels = sorted(set(grades))
    if len(levels) < 2:
        return {"levels": levels or [0], "weights": {}, "thresholds": np.zeros(0)}
    number: dict[str, int] = {}         # words are kept once, rows as numbers
    rows = [np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in texts]
    df = np.bincount(np.concatenate(rows), minlength=len(number)) if number else np.zeros(0, np.int64)
    slot = np.full(len(number), -1)
    slot[df >= MIN_DOCS] = np.arange(int((df >= MIN_DOCS).sum()))
    vocab = {w: int(slot[i]) for w, i in number.items() if slot[i] >= 0}
    ids = [slot[r][slot[r] >= 0] for r in rows]
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    col = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    y = np.searchsorted(levels, grades)
    n, m, k = len(y), len(vocab), len(levels) - 1
    high = y > 0
    up = np.bincount(col[high[row]], minlength=m) + 1.0
    down = np.bincount(col[~high[row]], minlength=m) + 1.0
    scale = np.abs(np.log(up / (high.sum() + 2.0)) - np.log(down / ((~high).sum() + 2.0)))
    x = scale[col]
    sample = np.bincount(y, minlength=k + 1) / n
    weight = np.array([shares.get(g, 0.0) for g in levels])[y] / sample[y]
    weight /= weight.sum()

    def split(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and thresholds; gaps are kept positive by an exponential."""
        return p[:m], p[m] + np.concatenate(([0.0], np.cumsum(np.exp(p[m + 1:]))))

    p = np.zeros(m + k)
    step = np.zeros_like(p)
    for _ in range(ROUNDS):
        w, t = split(p)
        s = np.bincount(row, w[col] * x, n)
        above = np.concatenate((t, [np.inf]))[y] - s
        under = np.concatenate(([-np.inf], t))[y] - s
        hi, lo = _sigmoid(above), _sigmoid(under)
        prob = np.maximum(hi - lo, 1e-12)
        slope_hi, slope_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        g_s = weight * (slope_hi - slope_lo)                    # of the loss by the score
        g_t = np.zeros(k)
        np.add.at(g_t, y[y < k], -(weight * slope_hi)[y < k])
        np.add.at(g_t, y[y > 0] - 1, (weight * slope_lo)[y > 0])
        grad = np.empty_like(p)
        grad[:m] = np.bincount(col, g_s[row] * x, m) + L2 * w / max(m, 1)
        grad[m] = g_t.sum()
        grad[m + 1:] = np.cumsum(g_t[::-1])[::-1][1:] * np.exp(p[m + 1:])
        step += grad * grad
        p -= 0.3 * grad / (np.sqrt(step) + 1e-10)
    w, t = split(p)
    return {"levels": levels, "thresholds": t,
            "weights": {v: float(w[i] * scale[i]) for v, i in vocab.items() if w[i]}}


def _scores(model: dict, texts: pd.Series) -> np.ndarray:
    """Probability of each level for each text."""
    get = model["weights"].get
    s = np.array([sum(get(w, 0.0) for w in words(t)) for t in texts], float)
    below = _sigmoid(model["thresholds"][None, :] - s[:, None])
    edges = np.concatenate((np.zeros((len(s), 1)), below, np.ones((len(s), 1))), axis=1)
    return np.diff(edges, axis=1)


def grade(docs: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """``id, severity, grade, toxic, score`` of every document: expected
    severity, likeliest grade, whether that is above the lowest, and the
    severity scaled to 0..1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)      # bounded by the training sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        levels = np.array(m["levels"], float)
        span = (levels[-1] - levels[0]) or 1.0
        for b in batches:
            p = _scores(m, b["text"])
            severity = p @ levels
            best = p.argmax(axis=1)
            yield pd.DataFrame({id_col: b[id_col].astype("Int64"), "severity": severity,
                                "grade": levels[best].astype("int32"), "toxic": (best > 0).astype("int32"),
                                "score": np.clip((severity - levels[0]) / span, 0.0, 1.0)})
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), "text")
    return rows.mapInPandas(run, f"`{id_col}` long, severity double, grade int, toxic int, score double")


def train(docs: DataFrame, labels: DataFrame, grade_col: str) -> dict:
    """Model from ``labels(doc_id, <grade_col>)`` and the texts of ``docs``."""
    known = labels.where(F.col(grade_col).isNotNull() & F.col("doc_id").isNotNull()) \
                  .groupBy("doc_id").agg(F.min(grade_col).alias("grade"))
    counts = {r["grade"]: r["n"] for r in known.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values()) or 1
    rows = sample_rows(docs.select("doc_id", "text"), sample_ids(known, "grade", SAMPLE_DOCS)).select("doc_id", "grade", "text")
    kind = rows.schema["grade"].dataType.simpleString()
    rows = lean_map(rows, _word_rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, grade {kind}, words array<string>") \
        .orderBy("doc_id").toArrow()
    return fit_words((x.as_py() for x in rows.column("words")), rows.column("grade").to_pylist(), {g: n / total for g, n in counts.items()})


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sorted(words(t.as_py())) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(found, pa.list_(pa.string()))],
                                         ["doc_id", "grade", "words"])


def severity(docs: DataFrame, labels: DataFrame, grade_col: str = "toxic") -> DataFrame:
    return grade(docs, train(docs, labels, grade_col))
