"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

Terms are trigrams of byte classes (lower and upper case letters, digits,
spaces, line ends, every ASCII sign for itself, and the halves of accented
letters), words, and "the same word again".  Words are runs of letters, digits
and bytes above ASCII, in lower case, hashed to ``WORD_SLOTS`` slots; words of
``LONG_WORD`` bytes or more share one slot.  The ``TERMS`` class terms and the
``WORD_TERMS`` words that most labelled texts hold are kept.  A document's
vector is its tf-idf over the terms projected on the leading singular vectors
of the labelled sample, scaled to unit length.  The labelled vectors (at most ``SAMPLE_DOCS`` rows of
``RANK`` numbers) are broadcast; the cosines of every document with all of
them are computed in blocks, exactly, and the ``NEIGHBOURS`` nearest vote with
weights growing with their similarity.  ``score`` is the weighted share of
label 1.

Training takes the ``SAMPLE_DOCS`` labelled rows with the smallest id hashes;
their terms are counted over whole texts on the executors and only the counts
are brought together.  Scoring reads every text whole, in windows of
``WINDOW`` bytes.

Defined cases: null and empty texts have no vector and score the share of
label 1 in the sample; with no labelled rows every score is 0.5; equally near
neighbours are taken in order of their ids; several labels of one id count as
the smallest; labels that are null or without a document are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import id_crc, lean_map, sample_ids, sample_rows, sum_rows, utf8_buffer

SAMPLE_DOCS = 4000
TERMS = 1024
WORD_TERMS = 1024
WORD_SLOTS = 1 << 16
LONG_WORD = 64
WORD_WEIGHT = 0.3
RANK = 24
NEIGHBOURS = 25
SHARPNESS = 20.0
THRESHOLD = 0.3
WINDOW = 1 << 18
BLOCK = 512


def _classes() -> np.ndarray:
    """Class of each byte value; 0 stands for the start of a text."""
    c = np.zeros(256, np.int64)
    signs = 6
    for b in range(256):
        if 97 <= b <= 122:
            c[b] = 1
        elif 65 <= b <= 90:
            c[b] = 2
        elif 48 <= b <= 57:
            c[b] = 3
        elif b == 32:
            c[b] = 4
        elif b < 32 or b == 127:
            c[b] = 5
        elif b < 128:
            c[b] = signs
            signs += 1
    c[128:160] = signs              # upper half of a two-byte capital
    c[160:192] = signs + 1
    c[192:] = signs + 2
    return c


CLASS = _classes()
CLASSES = int(CLASS.max()) + 1
AGAIN = CLASSES ** 3                # the term "the same word again"
WORD = AGAIN + 1                    # the first slot of the words
CODES = WORD + WORD_SLOTS + 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.array([chr(b).isalnum() or b > 127 for b in range(256)])


def _words(data: np.ndarray, offsets: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (from ``start``) of the last bytes of the words that end in the
    window, and the words' terms."""
    lead = max(int(offsets[0]), start - LONG_WORD)
    raw = data[lead:stop]
    heads = offsets[np.searchsorted(offsets, lead):np.searchsorted(offsets, stop, "right")] - lead
    ended = bool(len(heads)) and int(heads[-1]) == len(raw)     # a text ends with the window
    heads = heads[heads < len(raw)]
    word = _IN_WORD[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[heads] = True
    begins[-1] = ended or not _IN_WORD[data[stop]]
    at = np.flatnonzero(word)
    first = begins[at] | (at == 0) | ~word[at - 1]
    last = begins[at + 1] | ~np.append(word, True)[at + 1]      # a word that goes on past the window has begins[-1] unset
    if stop < len(data) and len(at) and at[-1] == len(raw) - 1:
        last[-1] = begins[-1]
    if not first.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads_at = np.flatnonzero(first)
    size = np.diff(np.append(heads_at, len(at)))
    place = np.arange(len(at)) - np.repeat(heads_at, size)
    mixed = (_LOWER[raw[at]].astype(np.uint64) + np.uint64(1)) * ((place.astype(np.uint64) + np.uint64(1)) * _STEP)
    mixed ^= mixed >> np.uint64(31)
    h = np.add.reduceat(mixed * _STEP, heads_at)
    term = WORD + ((h ^ (h >> np.uint64(29))) * _STEP >> np.uint64(40)).astype(np.int64) % WORD_SLOTS
    term[size >= LONG_WORD] = WORD + WORD_SLOTS
    tail = heads_at + size - 1
    end = at[tail] + lead - start
    done = last[tail] & (end >= 0)
    return end[done], term[done]


def _terms(data: np.ndarray, offsets: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Trigram term of each byte of the window, and whether the byte ends a
    word equal to the word before it in the same text (words that reach back
    beyond the window's lead count as new)."""
    begin = int(offsets[0])
    lead = max(begin, start - 64)
    raw = data[lead:stop]
    cls = CLASS[raw]
    heads = offsets[np.searchsorted(offsets, lead):np.searchsorted(offsets, stop, "right")] - lead
    heads = heads[heads < len(raw)]
    term = cls.copy()
    for back, weight in ((1, CLASSES), (2, CLASSES ** 2)):
        past = np.zeros(len(cls), np.int64)
        past[back:] = cls[:-back]
        for d in range(back):
            past[heads[heads + d < len(cls)] + d] = 0
        term += past * weight
    inside = raw > 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[heads[inside[heads]]] = True
    again = np.zeros(len(raw), bool)
    starts = np.flatnonzero(first)
    if len(starts) > 1:
        follow = np.append(starts[1:], len(raw))
        text_of = np.searchsorted(heads, starts, "right")
        # order-dependent hash of the word: bytes weighted by powers of their place in it
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))), axis=0) \
            if starts[0] == 0 else None
        if place is None:
            place = np.zeros(len(raw), np.int64)
            place[starts[0]:] = np.arange(starts[0], len(raw)) - np.repeat(starts, follow - starts)
        mixed = (raw.astype(np.uint64) + np.uint64(1)) * ((place.astype(np.uint64) + np.uint64(1)) * _STEP)
        mixed ^= mixed >> np.uint64(31)
        mixed *= inside
        h = np.add.reduceat(mixed, starts)
        size = np.add.reduceat(inside.astype(np.int64), starts)
        same = (h[1:] == h[:-1]) & (size[1:] == size[:-1]) & (text_of[1:] == text_of[:-1])
        again[starts[1:][same]] = True
    skip = start - lead
    return term[skip:], again[skip:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts of whole texts: ``codes``, ``times``, ``again`` and ``size``
    (bytes)."""
    for b in batches:
        data, offsets = utf8_buffer(b.column("text"))
        codes, times, again, size = [], [], [], []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            raw = data[lo:hi]
            term, same = _terms(raw, np.array([0, len(raw)]), 0, len(raw))
            words = _words(raw, np.array([0, len(raw)]), 0, len(raw))[1]
            code, n = np.unique(np.concatenate((term, words)), return_counts=True)
            codes.append(code)
            times.append(n)
            again.append(int(same.sum()))
            size.append(max(1, len(raw)))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("label"), pa.array(codes, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64())),
             pa.array(again, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "label", "codes", "times", "again", "size"])


def fit(texts: list[str], labels: list[int]) -> dict | None:
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "label": labels, "text": pa.array(texts, pa.string())})
    counted = next(_counted(iter([rows])))
    return fit_counts(counted.to_pylist(), labels)


def fit_counts(counted: list[dict], labels: list[int]) -> dict | None:
    """Model from the term counts of the sample (``_counted``)."""
    if not counted:
        return None
    rows = [(np.array(r["codes"], np.int64), np.array(r["times"], np.int64), r["again"], r["size"]) for r in counted]
    df = np.zeros(CODES)
    for code, _, again, _ in rows:
        df[code] += 1
        df[AGAIN] += again > 0
    most = lambda n, first, stop: first + np.argsort(-df[first:stop], kind="stable")[:min(n, int((df[first:stop] > 0).sum()))]
    kept = np.sort(np.concatenate((most(TERMS, 0, WORD), most(WORD_TERMS, WORD, CODES))))
    slot = np.full(CODES, -1)
    slot[kept] = np.arange(len(kept))
    idf = np.log((1.0 + len(rows)) / (1.0 + df[kept]))
    x = np.zeros((len(rows), len(kept)))
    for i, (code, n, again, size) in enumerate(rows):
        at = slot[code]
        x[i, at[at >= 0]] = n[at >= 0] / size
        if slot[AGAIN] >= 0:
            x[i, slot[AGAIN]] = again / size
    weight = idf * np.where(kept >= WORD, WORD_WEIGHT, 1.0)
    x *= weight
    values, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, ::-1][:, :RANK] * weight[:, None]
    project = np.zeros((CODES, basis.shape[1]), np.float32)
    project[kept] = basis
    own = _unit(x @ vectors[:, ::-1][:, :RANK])
    return {"project": project, "vectors": own, "labels": np.array(labels, float), "prior": float(np.mean(labels))}


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)


def vectors(data: np.ndarray, offsets: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the rows (zero for empty ones)."""
    total = np.zeros((len(offsets) - 1, project.shape[1]))
    for start in range(int(offsets[0]), int(offsets[-1]), WINDOW):
        stop = min(int(offsets[-1]), start + WINDOW)
        term, again = _terms(data, offsets, start, stop)
        values = project[term]
        values[again] += project[AGAIN]
        ends, words = _words(data, offsets, start, stop)
        values[ends] += project[words]
        sum_rows(values, offsets, start, total)
    return _unit(total)


def vote(x: np.ndarray, model: dict) -> np.ndarray:
    out = np.full(len(x), model["prior"])
    known = np.flatnonzero(np.abs(x).sum(axis=1) > 0)
    k = min(NEIGHBOURS, len(model["labels"]))
    for at in range(0, len(known), BLOCK):
        rows = known[at:at + BLOCK]
        cosine = np.round(x[rows] @ model["vectors"].T, 12)
        least = np.partition(cosine, -k, axis=1)[:, -k][:, None]
        above, level = cosine > least, cosine == least
        # of those level with the last place the first by id, which is their order
        near = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1)[:, None]))
        weight = np.exp(SHARPNESS * (cosine - 1.0)) * near
        out[rows] = weight @ model["labels"] / weight.sum(axis=1)
    return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` of every document."""
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)      # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            s = vote(vectors(*utf8_buffer(b.column("_text")), m["project"]), m)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                [*keep, "score", "predicted"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in keep))
    return lean_map(docs.select(*keep, F.col("text").alias("_text")), run, f"{schema}, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality") -> dict | None:
    known = labels.where(usable & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()) \
                  .groupBy("doc_id").agg(F.min(label_col).alias("label")).withColumn("all", F.lit(0))
    first = sample_ids(known, "all", SAMPLE_DOCS).drop("all").join(known.drop("all"), "doc_id")
    rows = sample_rows(docs.select("doc_id", "text"), first).where("text <> ''")
    rows = rows.select("doc_id", (F.col("label") == 1).cast("int").alias("label"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = lean_map(rows, _counted, f"doc_id {kind}, label int, codes array<long>, times array<long>, again long, size long") \
        .orderBy("doc_id").toArrow().to_pylist()
    return fit_counts(counted, [r["label"] for r in counted])


def held_out() -> Column:
    return id_crc() % 5 == 0


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(docs, labels, ~held_out())
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model, ["doc_id", "held_out"])
