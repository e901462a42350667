"""Repair of the turn structure of conversations.

A row's first fault counts: ``blank`` (no ``[^\\x20\\x09-\\x0D]`` in its text),
``duplicate`` (role and text seen earlier in the conversation), ``truncated``
(its last such character is not one of ``.!?``).  Edits make the role initials
``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 1, Delete 2 (blank
and duplicate rows must go), Insert an empty user or assistant turn anywhere
5; a truncated row that stays adds 5.  Of the cheapest edits those whose
initials come first in ASCII are taken.

Method: run-length dynamic programming.  A row is a symbol (role initial and
fault); equal consecutive symbols are one run.  A symbol's step is a min-plus
matrix over four states (nothing yet, after system, after user, after
assistant); a run of n rows is advanced by cached binary powers of it.  With
the cost to go known behind each run, the choices are unrolled forward, again
by halves whose results are cached.

On the cluster, rows of equal conversation, turn, role and text are counted
first (they are interchangeable) and only keys and flags are ordered: by range
partitions over (conversation, turn, role, text digest), so that one
conversation may span any number of tasks.  A task reads its slice backwards
and writes pieces of at most ``PIECE`` rows with the product of the matrices
behind them.  The products of a conversation's slices (at most one a
partition) give the cost to go behind each slice; its pieces are then unrolled
from every state in which the slice may be entered, and the chain of these
states picks the one that holds.  Texts travel twice: to meet their edits
(deleted rows end there), then by conversation to be hashed in order as a
stream, since SHA-256 has no parallel form.

Defined cases: a null role or text is one space; null turns come first and
rows of one turn go by role, then by the text's SHA-256; a null conversation
id is a conversation of its own; other columns are ignored; an empty table
gives an empty one.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import lean_map, shuffle_width
from marketlens.sources.store import materialize

#: Distinct rows a piece holds at most.
PIECE = 2_048
#: Pieces a task sends on at once.
PIECES_OUT = 256
INF = 1 << 40
FILLED = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
STATES = range(4)
ENDS = (0, 3)
#: Role initials that may follow each other.
LEGAL = {"su", "ua", "au"}
Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]
IDENTITY: Matrix = tuple(tuple(0 if i == j else INF for j in STATES) for i in STATES)


# ------------------------------------------------------------------ the dynamic program

def _turn_of(state: int) -> int:
    """State after a user or assistant turn is put at ``state``."""
    return 3 if state == 2 else 2


def _kept(state: int, initial: str) -> int | None:
    """State after a kept row, if it may stand there."""
    if initial == "s":
        return 1 if state == 0 else None
    goes = {"u": 2, "a": 3}.get(initial)
    return goes if goes == _turn_of(state) else None


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(INF, min(a[i][k] + b[k][j] for k in STATES)) for j in STATES) for i in STATES)


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(INF, min(a[i][k] + v[k] for k in STATES)) for i in STATES)


def _inserts() -> Matrix:
    """Any number of inserted turns."""
    one = [[INF] * 4 for _ in STATES]
    for i in STATES:
        one[i][i] = 0
        one[i][_turn_of(i)] = 5
    m: Matrix = tuple(map(tuple, one))
    return times(times(m, m), m)


INSERTS = _inserts()
#: Cost to go behind the last row.
AT_END = apply(INSERTS, tuple(0 if s in ENDS else INF for s in STATES))


def symbol(initial: str, fault: str) -> str:
    """``x`` for rows that must go, else the initial (``o`` for others), in
    upper case if truncated."""
    if fault in ("blank", "duplicate"):
        return "x"
    s = initial if initial in ("s", "u", "a") else "o"
    return s.upper() if fault == "truncated" else s


def _choices(sym: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of one row, without inserts."""
    out = [("D", 2, state)]
    if sym != "x":
        more = 5 if sym.isupper() else 0
        goes = _kept(state, sym.lower())
        if goes is not None:
            out.append(("K", more, goes))
        out.append(("R", 1 + more, _turn_of(state)))
    return out


@lru_cache(maxsize=None)          # 9 symbols, powers up to the length of the longest run
def power(sym: str, k: int) -> Matrix:
    """Matrix of ``2 ** k`` equal rows."""
    if k:
        half = power(sym, k - 1)
        return times(half, half)
    step = [[INF] * 4 for _ in STATES]
    for state in STATES:
        for _, cost, goes in _choices(sym, state):
            step[state][goes] = min(step[state][goes], cost)
    return times(INSERTS, tuple(map(tuple, step)))


@lru_cache(maxsize=1 << 14)
def run_matrix(sym: str, n: int) -> Matrix:
    out, k = IDENTITY, 0
    while n:
        if n & 1:
            out = times(out, power(sym, k))
        n, k = n >> 1, k + 1
    return out


def _level(v: Vector) -> Vector:
    low = min(v)
    return tuple(min(INF, x - low) for x in v) if low < INF else v


def _insert_first(state: int, v: Vector) -> bool:
    return v[state] < INF and 5 + v[_turn_of(state)] == v[state]


@lru_cache(maxsize=1 << 14)
def _step(sym: str, state: int, after: Vector) -> tuple[str, int]:
    """Edits of one row (with the inserts before it) and the state behind it."""
    here, out = apply(power(sym, 0), after), ""
    while True:
        found = {e: goes for e, cost, goes in _choices(sym, state) if cost + after[goes] == here[state]}
        if "D" in found:
            return out + "D", found["D"]
        if _insert_first(state, here):
            out, state = out + "I", _turn_of(state)
            continue
        edit = "K" if "K" in found else "R"
        return out + edit, found[edit]


def _unroll(sym: str, k: int, state: int, after: Vector) -> tuple[str, int]:
    """Edits of ``2 ** k`` equal rows; small blocks are cached."""
    if k == 0:
        return _step(sym, state, after)
    if k <= 10:
        return _unroll_cached(sym, k, state, after)
    return _halves(sym, k, state, after)


def _halves(sym: str, k: int, state: int, after: Vector) -> tuple[str, int]:
    first, state = _unroll(sym, k - 1, state, _level(apply(power(sym, k - 1), after)))
    second, state = _unroll(sym, k - 1, state, after)
    return first + second, state


_unroll_cached = lru_cache(maxsize=1 << 12)(_halves)


def unroll_run(sym: str, n: int, state: int, after: Vector) -> tuple[str, int]:
    """Edits of ``n`` equal rows from ``state``, with the cost to go ``after`` them."""
    out, rest = [], n
    while rest:
        k = rest.bit_length() - 1
        rest -= 1 << k
        edits, state = _unroll(sym, k, state, _level(apply(run_matrix(sym, rest), after)))
        out.append(edits)
    return "".join(out), state


def unroll(runs: list[tuple[str, int]], state: int, after: Vector) -> tuple[str, int]:
    """Edits of successive runs and the state behind them."""
    behind = [_level(after)]
    for sym, n in reversed(runs[1:]):
        behind.append(_level(apply(run_matrix(sym, n), behind[-1])))
    out = []
    for (sym, n), v in zip(runs, reversed(behind)):
        edits, state = unroll_run(sym, n, state, v)
        out.append(edits)
    return "".join(out), state


def at_end(state: int) -> str:
    """Inserts behind the last row."""
    out = ""
    while state not in ENDS:
        out, state = out + "I", _turn_of(state)
    return out


def collapsed(symbols: Iterator[tuple[str, int]]) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for sym, n in symbols:
        if out and out[-1][0] == sym:
            out[-1] = (sym, out[-1][1] + n)
        elif n:
            out.append((sym, n))
    return out


# ------------------------------------------------------------------ rows and their faults

def keyed(rows: DataFrame) -> DataFrame:
    """Conversation key, turn key, role, text and its digest, nulls replaced."""
    return rows.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("-")).alias("conv"),
        F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text")) \
        .withColumn("digest", F.unhex(F.sha2("text", 256)))


KEY = ["conv", "known", "turn", "role", "digest"]


def _with_faults(rows: DataFrame) -> DataFrame:
    """Distinct rows of ``keyed`` without texts: copies ``n``, ``fault`` of the
    first copy, whether later copies are blank or duplicates."""
    flags = rows.select(*KEY, F.rlike("text", F.lit(FILLED)).alias("filled"),
                        F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1).isin(".", "!", "?").alias("closed"))
    counted = flags.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("filled").alias("filled"), F.max("closed").alias("closed"))
    firsts = counted.groupBy("conv", "role", "digest").agg(F.min(F.struct("known", "turn")).alias("first")) \
                    .select("conv", F.col("first.known").alias("known"), F.col("first.turn").alias("turn"), "role", "digest",
                            F.lit(True).alias("first"))
    fault = F.when(~F.col("filled"), "blank").when(F.col("first").isNull(), "duplicate") \
             .when(~F.col("closed"), "truncated").otherwise("")
    return counted.join(firsts, KEY, "left").select(*KEY, "n", fault.alias("fault"))


PIECES = ("conv string, slice int, no long, known array<boolean>, turn array<long>, role array<string>, digest array<binary>, "
          "n array<long>, fault array<string>, behind array<long>, whole array<long>, head boolean, stats array<long>, low long, high long, "
          "first_known boolean, first_turn long, last_known boolean, last_turn long, first_initial string, last_initial string")


def _flat(m: Matrix) -> list[int]:
    return [x for row in m for x in row]


def _square(flat) -> Matrix:
    return tuple(tuple(int(x) for x in flat[4 * i:4 * i + 4]) for i in STATES)


def _symbols(role: str, fault: str, n: int) -> list[tuple[str, int]]:
    first = symbol(role[:1], fault)
    return [(first, 1), ("x", n - 1)] if n > 1 else [(first, 1)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a slice that arrives last row first."""
    held: list[dict] = []
    state = {"conv": None, "no": 0, "matrix": IDENTITY, "next": None}
    schema = _arrow(PIECES)

    def flush(head: bool) -> dict:
        rows = held[::-1]
        own = IDENTITY
        for sym, n in collapsed(s for r in rows for s in _symbols(r["role"], r["fault"], r["n"])):
            own = times(own, run_matrix(sym, n))
        behind = state["matrix"]
        state["matrix"] = times(own, behind)
        stats = [0, 0, 0, 0, 0, 0]        # distinct known turns, blank, duplicate, truncated, illegal pairs, rows
        for r, follows in zip(rows, [*rows[1:], state["next"]]):
            n, fault, initial = r["n"], r["fault"], r["role"][:1]
            if follows is None or (follows["known"], follows["turn"]) != (r["known"], r["turn"]):
                stats[0] += r["known"]
            stats[1] += n if fault == "blank" else 0
            stats[2] += n if fault == "duplicate" else 0 if fault == "blank" else n - 1
            stats[3] += fault == "truncated"
            stats[4] += n - 1 + (follows is not None and initial + follows["role"][:1] not in LEGAL)    # copies never alternate
            stats[5] += n
        turns = [r["turn"] for r in rows if r["known"]]
        piece = {"conv": state["conv"], "slice": rows[0]["slice"], "no": state["no"], "behind": _flat(behind),
                 "whole": _flat(state["matrix"]), "head": head, "stats": stats,
                 "low": min(turns, default=None), "high": max(turns, default=None)}
        for c in ("known", "turn", "role", "digest", "n", "fault"):
            piece[c] = [r[c] for r in rows]
        for end, r in (("first", rows[0]), ("last", rows[-1])):
            piece |= {f"{end}_known": r["known"], f"{end}_turn": r["turn"], f"{end}_initial": r["role"][:1]}
        held.clear()
        state["next"] = rows[0]
        state["no"] += 1
        return piece

    for b in batches:
        out = []
        for values in zip(*(c.to_pylist() for c in b.columns)):
            r = dict(zip(b.schema.names, values))
            if held and (r["conv"] != state["conv"] or len(held) == PIECE):
                out.append(flush(r["conv"] != state["conv"]))
            if r["conv"] != state["conv"]:
                state.update(conv=r["conv"], no=0, matrix=IDENTITY, next=None)
            held.append(r)
            if len(out) >= PIECES_OUT:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)
    if held:
        yield _batch([flush(True)], schema)


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    fields = []
    for f in ddl.split(", "):
        name, kind = f.split(" ")
        inner = kind[6:-1] if kind.startswith("array<") else None
        fields.append(pa.field(name, pa.list_(_KINDS[inner]) if inner else _KINDS[kind]))
    return pa.schema(fields)


def pieces(rows: DataFrame) -> DataFrame:
    """``PIECES`` of all conversations of ``keyed`` rows, written once."""
    spark = rows.sparkSession
    order = ["conv", "known", "turn", "role", "digest"]
    ordered = _with_faults(rows).repartitionByRange(shuffle_width(spark), *order) \
        .sortWithinPartitions(*[F.col(c).desc() for c in order]).withColumn("slice", F.spark_partition_id())
    return materialize(spark, lean_map(ordered, _pieces, PIECES), "conversation-pieces")


# ------------------------------------------------------------------ slices of a conversation

def _chain(group: pd.DataFrame) -> pd.DataFrame:
    """Cost to go behind each slice of one conversation (a row a slice)."""
    group = group.sort_values("slice", ascending=False)
    v, out = AT_END, []
    for i, (s, whole) in enumerate(zip(group["slice"], group["whole"])):
        out.append((group["conv"].iloc[0], int(s), list(map(int, v)), i == 0, i == len(group) - 1, None))
        v = apply(_square(whole), v)
    out[-1] = (*out[-1][:-1], int(v[0]))
    return pd.DataFrame(out, columns=["conv", "slice", "after", "final", "initial", "cost"]).astype({"cost": "Int64"})


def slices(parts: DataFrame) -> DataFrame:
    """``conv, slice, after, final, initial, cost`` of every slice; the cost
    of the whole conversation is on its initial slice."""
    heads = parts.where("head").select("conv", "slice", "whole")
    edges = heads.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    known = heads.join(edges, "conv")
    lone = known.where("n = 1").select(
        "conv", "slice", F.array(*[F.lit(x).cast("long") for x in AT_END]).alias("after"), F.lit(True).alias("final"),
        F.lit(True).alias("initial"), F.array_min(F.array(*[F.get("whole", F.lit(k)) + F.lit(AT_END[k]) for k in STATES])).alias("cost"))
    long = known.where("n > 1").drop("n").groupBy("conv").applyInPandas(
        _chain, "conv string, slice int, after array<long>, final boolean, initial boolean, cost long")
    return lone.unionByName(long)


EDITS = ("conv string, slice int, no long, entry int, leaves int, edits string, known array<boolean>, turn array<long>, "
         "was array<string>, digest array<binary>, edit array<string>, role array<string>")
NAMES = {2: "user", 3: "assistant"}


def _lines(rows: dict, edits: str, tail: str, state: int) -> dict:
    """The turns that remain of a piece, inserted ones included, in order:
    arrays by column of ``EDITS``.  Later copies of a row are always deleted,
    and nothing is inserted before a deleted row."""
    out: dict[str, list] = {c: [] for c in ("known", "turn", "was", "digest", "edit", "role")}

    def add(edit: str, role: str, k: int | None) -> None:
        own = [None] * 4 if k is None else [rows[c][k] for c in ("known", "turn", "role", "digest")]
        for c, x in zip(out, (*own, edit, role)):
            out[c].append(x)

    at = 0
    for k, n in enumerate(rows["n"]):
        while edits[at] == "I":
            state, at = _turn_of(state), at + 1
            add("I", NAMES[state], None)
        if edits[at] == "K":
            state = _kept(state, rows["role"][k][:1])
            add("K", rows["role"][k], k)
        elif edits[at] == "R":
            state = _turn_of(state)
            add("R", NAMES[state], k)
        at += n
    for _ in tail:
        state = _turn_of(state)
        add("I", NAMES[state], None)
    return out


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each piece from every state in which its slice may be entered.
    The pieces of a slice arrive in order."""
    schema = _arrow(EDITS)
    place, reached = None, {}
    for b in batches:
        out: list[dict] = []
        for values in zip(*(c.to_pylist() for c in b.columns)):
            r = dict(zip(b.schema.names, values))
            if place != (r["conv"], r["slice"]):
                place = r["conv"], r["slice"]
                reached = {0: 0} if r["initial"] else {s: s for s in STATES}
            after = apply(_square(r["behind"]), tuple(r["after"]))
            runs = collapsed(s for row in zip(r["role"], r["fault"], r["n"]) for s in _symbols(*row))
            for entry, state in reached.items():
                edits, leaves = unroll(runs, state, after)
                reached[entry] = leaves
                tail = at_end(leaves) if r["final"] and r["no"] == 0 else ""
                out.append({"conv": r["conv"], "slice": r["slice"], "no": r["no"], "entry": entry, "leaves": leaves,
                            "edits": edits + tail, **_lines(r, edits, tail, state)})
            if len(out) >= PIECES_OUT:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)


def _entries(group: pd.DataFrame) -> pd.DataFrame:
    """State in which each slice of one conversation is entered (four rows a slice)."""
    goes = {(int(s), int(e)): int(x) for s, e, x in zip(group["slice"], group["entry"], group["leaves"])}
    state, out = 0, []
    for s in sorted({s for s, _ in goes}):
        out.append((group["conv"].iloc[0], s, state))
        state = goes[s, state]
    return pd.DataFrame(out, columns=["conv", "slice", "enters"])


def chosen(parts: DataFrame, sliced: DataFrame) -> DataFrame:
    """``EDITS`` of every piece from the state in which it is really entered."""
    need = parts.select("conv", "slice", "no", "known", "turn", "role", "digest", "n", "fault", "behind")
    tried = need.join(sliced.drop("cost"), ["conv", "slice"]).repartition("conv", "slice") \
                .sortWithinPartitions("conv", "slice", F.col("no").desc())
    tried = materialize(parts.sparkSession, lean_map(tried, _edits, EDITS), "conversation-edits")
    spanning = sliced.where(~F.col("initial")).select("conv").distinct()
    entered = tried.where("no = 0").select("conv", "slice", "entry", "leaves").join(spanning, "conv", "left_semi") \
                   .groupBy("conv").applyInPandas(_entries, "conv string, slice int, enters int")
    return tried.join(entered, ["conv", "slice"], "left").where(F.coalesce("enters", F.lit(0)) == F.col("entry")).drop("enters")


# ------------------------------------------------------------------ results


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The turns that remain: ``conv, slice, no, at`` (order: slice, no
    descending, at), ``edit`` (K, R or I), ``role`` and ``text``."""
    texts = rows.groupBy(*KEY).agg(F.any_value("text").alias("text"))
    columns = ["known", "turn", "was", "digest", "edit", "role"]
    lines = edits.select("conv", "slice", "no", F.posexplode(F.arrays_zip(*columns)).alias("at", "_l")) \
                 .select("conv", "slice", "no", "at", *[F.col(f"_l.{c}").alias(c) for c in columns])
    out = ["conv", "slice", "no", "at", "edit", "role", "text"]
    added = lines.where("edit = 'I'").withColumn("text", F.lit("")).select(*out)
    kept = lines.where("edit <> 'I'").join(texts.withColumnRenamed("role", "was"), ["conv", "known", "turn", "was", "digest"])
    return kept.select(*out).unionByName(added)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which arrive in order."""
    conv, digest = None, None
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    for b in batches:
        done = []
        for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv", "role", "text"))):
            if c != conv:
                if conv is not None:
                    done.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if conv is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema)


def _statistics(parts: DataFrame) -> DataFrame:
    """Gaps and faults by conversation.  Neighbouring rows of one slice are
    compared while its pieces are made; here those across slices."""
    names = ("turns", "blank", "duplicate", "truncated", "illegal", "rows")
    by_slice = parts.groupBy("conv", "slice").agg(
        *[F.sum(F.get("stats", F.lit(k))).alias(c) for k, c in enumerate(names)], F.min("low").alias("low"), F.max("high").alias("high"),
        F.max(F.when(F.col("head"), F.struct("first_known", "first_turn", "first_initial"))).alias("first"),
        F.max(F.when(F.col("no") == 0, F.struct("last_known", "last_turn", "last_initial"))).alias("last"))
    before = F.lag("last").over(Window.partitionBy("conv").orderBy("slice"))     # at most a row a partition
    joined = by_slice.withColumn("before", before)
    same = F.col("before.last_known") & F.col("first.first_known") & (F.col("before.last_turn") == F.col("first.first_turn"))
    pair = F.concat("before.last_initial", "first.first_initial")
    return joined.groupBy("conv").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns") + F.sum(F.coalesce(same.cast("long"), F.lit(0))), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.sum(F.when(F.col("before").isNotNull() & ~pair.isin(*sorted(LEGAL)), 1).otherwise(0))).alias("illegal"))


def summary(original: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repair of ``rows`` (columns
    ``conv_id, turn, role, text``) for every conversation of ``original``."""
    keys = keyed(rows)
    parts = pieces(keys)
    sliced = materialize(rows.sparkSession, slices(parts), "conversation-slices")
    edits = chosen(parts, sliced)
    audit = edits.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("slice", (-F.col("no")).alias("no"), "edits"))).alias("a")) \
                 .select("conv", F.array_join(F.col("a.edits"), "").alias("audit"))
    lines = repaired(keys, edits).select("conv", "slice", "no", "at", "role", "text").repartition("conv") \
        .sortWithinPartitions("conv", "slice", F.col("no").desc(), "at").select("conv", "role", "text")
    digest = lean_map(lines, _hashed, "conv string, repaired_sha256 string")
    cost = sliced.where("initial").select("conv", "cost")
    all_ids = original.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")) \
                      .select("conv_id", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("-")).alias("conv"))
    joined = all_ids.join(_statistics(parts), "conv", "left").join(cost, "conv", "left").join(audit, "conv", "left").join(digest, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """The given conversations with faults put in by ``crc32(conv_id:turn) % 20``:
    0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it,
    4 makes it the user's.  A null counts as one space, also in the key."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"),
                       (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("_d <> 0").select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"),
                                        text.alias("text"), copies.alias("_copy")).drop("_copy")
