"""Fill-in-the-middle transformation of whole texts.

A text of ``n`` units is cut at two seeded places into prefix, middle and
suffix, and written as ``<P>prefix<S>suffix<M>middle`` (psm) or
``<S>suffix<P>prefix<M>middle`` (spm); a part of the texts stays plain.

Units are tokens (``[A-Za-z]+|[^A-Za-z]``) or code points.  Cuts are found in
the UTF-8 bytes of a block of texts.  Only multibyte characters are recorded: a
sorted list of their positions and the running excess of their bytes over one
(``Exceptions``).  A binary search in it turns byte places into code points and
back; the ASCII stretches between the entries are plain arithmetic.

Seeds come from the SHA-256 of ``seed:doc_id``; its first four groups of eight
hex digits are h1 to h4.  Cuts are h1 and h2 modulo ``n + 1``, a text is plain
if it is empty, holds one of the three markers or h3 % 100 >= ``fim_percent``,
and else spm if h4 % 100 < ``spm_percent``.

Defined cases: null texts are empty, so plain; a null id counts as an empty
one; repeated rows give repeated results; very long texts form a block of
their own; an empty table gives an empty one.  Kept columns must not bear the
names of the result columns.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import lean_map, utf8_buffer

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts are worked on in blocks of about so many bytes.
BLOCK_BYTES = 1 << 21


class Exceptions:
    """Multibyte characters of a byte block: where each begins, how many bytes
    more than one the characters before it take, and its code point place."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        extra = 1 + (lead >= 0xE0) + (lead >= 0xF0)
        self.excess = np.concatenate(([0], np.cumsum(extra, dtype=np.int64)))
        self.place = self.at - self.excess[:-1]

    def to_chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before the byte places ``at`` (starts of characters)."""
        return at - self.excess[np.searchsorted(self.at, at)]

    def to_bytes(self, place: np.ndarray) -> np.ndarray:
        """Byte places of the code points ``place``."""
        return place + self.excess[np.searchsorted(self.place, place)]


def token_starts(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Byte places where tokens begin; ``heads`` are the places where texts do."""
    letter = ((data | 0x20) - np.uint8(97)) < 26
    goes_on = np.zeros(len(data), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[heads[heads < len(data)]] = False
    return np.flatnonzero(((data & 0xC0) != 0x80) & ~goes_on)


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``limit`` bytes, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def cuts(data: np.ndarray, offsets: np.ndarray, draws: tuple, unit: str) -> tuple:
    """For texts that fill ``data`` gaplessly: unit counts, then bytes and code
    points of the prefix's and the middle's end, counted from the text's start."""
    index = Exceptions(data)
    char_heads = index.to_chars(offsets)
    if unit == "token":
        starts = np.append(token_starts(data, offsets[:-1]), len(data))
        head = np.searchsorted(starts[:-1], offsets)
    else:
        head = char_heads
    n = np.diff(head)
    ends = []
    for draw in (np.minimum(*(d % (n + 1) for d in draws)), np.maximum(*(d % (n + 1) for d in draws))):
        at = starts[head[:-1] + draw] if unit == "token" else index.to_bytes(head[:-1] + draw)
        at = np.where(draw == n, offsets[1:], at)
        ends.append((at - offsets[:-1], index.to_chars(at) - char_heads[:-1]))
    (b1, c1), (b2, c2) = ends
    return n, b1, b2, c1, c2


def transform(docs: DataFrame, keep: list[str], seed: int = 1, unit: str = "token", id_col: str = "doc_id",
              fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``keep`` columns, ``n`` (units), ``form``, ``prefix_chars`` and
    ``middle_chars`` (null if plain) and ``output`` (the transformed text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    held = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | held | (draw(2) % 100 >= fim_percent), 0).when(draw(3) % 100 < spm_percent, 2).otherwise(1)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_text"), form.alias("_form"), draw(0).alias("_h1"), draw(1).alias("_h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8_buffer(b.column("_text"))
            for first, last in blocks(offsets):
                part = b.slice(first, last - first)
                yield _block(part, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], keep, unit)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in keep))
    return lean_map(rows, run, f"{schema}, n long, form string, prefix_chars long, middle_chars long, output string")


def _block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, keep: list[str], unit: str) -> pa.RecordBatch:
    form = rows.column("_form").to_numpy()
    draws = rows.column("_h1").to_numpy(), rows.column("_h2").to_numpy()
    n, b1, b2, c1, c2 = cuts(data, offsets, draws, unit)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    whole, out = data.tobytes(), []
    for kind, begin, end, x, y in zip(form.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), b1.tolist(), b2.tolist()):
        if not kind:
            out.append((whole[begin:end],))
            continue
        prefix, middle, suffix = whole[begin:begin + x], whole[begin + x:begin + y], whole[begin + y:end]
        out.append((p, prefix, s, suffix, m, middle) if kind == 1 else (s, suffix, p, prefix, m, middle))
    lengths = np.cumsum([0] + [sum(map(len, x)) for x in out], dtype=np.int32)
    texts = pa.Array.from_buffers(pa.string(), len(out), [None, pa.py_buffer(lengths), pa.py_buffer(b"".join(x for t in out for x in t))])
    plain = form == 0
    return pa.RecordBatch.from_arrays(
        [rows.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(np.array(["plain", "psm", "spm"], object)[form], pa.string()),
                                          pa.array(c1, pa.int64(), mask=plain), pa.array(c2 - c1, pa.int64(), mask=plain), texts],
        [*keep, "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: str = "output", form: str = "form") -> Column:
    """The original text from the output and its form alone.  A text that is
    not plain holds no marker, so the markers found are the ones put in."""
    text = F.col(output)
    size = len(PREFIX)
    second = F.when(F.col(form) == "psm", F.locate(SUFFIX, text)).otherwise(F.locate(PREFIX, text))
    third = F.locate(MIDDLE, text)
    one = F.substr(text, F.lit(size + 1), second - size - 1)
    two = F.substr(text, second + size, third - second - size)
    middle = F.substr(text, third + size)
    return F.when(F.col(form) == "plain", text).when(F.col(form) == "psm", F.concat(one, middle, two)) \
            .otherwise(F.concat(two, middle, one))


def digests(docs: DataFrame) -> DataFrame:
    """Digest columns of every document's output and of its restored text."""
    done = transform(docs, ["doc_id"])
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(), 256).alias("restored_sha256"))
