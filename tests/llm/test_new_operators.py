"""Conversation repair, external shuffle and fill-in-the-middle against plain versions."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marketlens.llm import conversations, fim, queries, sharding
from tests.conftest import SF

# ---------------------------------------------------------------- conversations


def plain_repair(rows):
    """Faults, cost, audit and repaired lines of one conversation: row by row,
    every state keeps its cheapest edits, and of those the ASCII-least."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    blank = dup = cut = 0
    seen, marked = set(), []
    for turn, role, text in rows:
        tail = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "b" if not tail else "d" if (role, text) in seen else "t" if tail[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, dup, cut = blank + (fault == "b"), dup + (fault == "d"), cut + (fault == "t")
        marked.append((role, text, fault))
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def better(out, state, new):
        if state not in out or new[:2] < out[state][:2]:
            out[state] = new

    def inserted(states):
        states = dict(states)
        for _ in range(4):
            for s, (c, e, lines) in list(states.items()):
                to = "a" if s == "u" else "u"
                better(states, to, (c + 5, e + "I", (*lines, {"u": "user:", "a": "assistant:"}[to])))
        return states

    for role, text, fault in marked:
        out = {}
        for s, (c, e, lines) in inserted(best).items():
            better(out, s, (c + 2, e + "D", lines))
            if fault not in ("b", "d"):
                more = 5 if fault == "t" else 0
                if role[:1] and role[:1] in nexts[s]:
                    better(out, role[:1], (c + more, e + "K", (*lines, f"{role}:{text}")))
                for to, name in (("u", "user"), ("a", "assistant")):
                    if to in nexts[s]:
                        better(out, to, (c + 1 + more, e + "R", (*lines, f"{name}:{text}")))
        best = out
    cost, audit, lines = min(v for s, v in inserted(best).items() if s in ("", "a"))
    return gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            out[conv] += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check_repair(got, ids, by_conv):
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}
    assert set(got) == set(ids)
    for c in ids:
        assert got[c] == plain_repair(by_conv.get(c, [])), c


def test_conversation_query_against_a_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(SF + "/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_run_length_repair(spark, SF).collect()
    check_repair(got, {r[0] for r in rows}, plain_damage(rows))


def test_conversations_with_odd_rows(spark):
    rng = random.Random(4)
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.choice([1, 2, 3, 5, 9, 30])):
            rows.append((conv, rng.choice([None, *range(8)]), rng.choice([None, "", "user", "assistant", "system", "tool", "unknown", "Ärzte"]),
                         rng.choice([None, "", " \n", "Yes.", "No!", "open", "é? ", "long " * 50 + ".", "end. ", "x.\t\r\n"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit("clash") for c in ("conv", "n", "slice", "fault", "digest")})
    damaged = conversations.damaged(df)
    check_repair(conversations.summary(df, damaged).collect(), {r[0] for r in rows}, plain_damage(rows))
    assert conversations.summary(df.where("1 = 0"), damaged.where("1 = 0")).count() == 0
    gone = conversations.summary(df, damaged.where("1 = 0")).collect()
    assert {tuple(r[c] for c in COLUMNS) for r in gone} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


@pytest.mark.parametrize("piece", [1, 7, 2048])
def test_one_conversation_over_many_slices(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rng = random.Random(piece)
    rows, turn = [], 0
    for _ in range(150):        # long runs of one symbol and short ones
        role = rng.choice(["user", "assistant", "system", "tool"])
        text = rng.choice(["Yes {}.", "open {}", "", "again.", "Sure {}!"])
        for _ in range(rng.choice([1, 1, 1, 2, 17])):
            rows.append((5, turn, role, text.format(turn)))
            turn += rng.choice([0, 1, 1, 3])
    rows += [(5, 3, "user", "copy.")] * 700
    rows += [(6, 0, "user", "Hi."), (6, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for c, *r in rows:
        by[c].append(tuple(r))
    check_repair(conversations.summary(df, df).collect(), {5, 6}, by)


def test_runs_are_advanced_and_unrolled_like_single_rows():
    rng = random.Random(2)
    for _ in range(300):
        runs = [(rng.choice("xsuaoSUAO"), rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 6))]
        runs = conversations.collapsed(iter(runs))
        single = [(s, 1) for s, n in runs for _ in range(n)]
        edits, state = conversations.unroll(runs, 0, conversations.AT_END)
        alone, s2, v = "", 0, [conversations.AT_END]
        for s, _ in reversed(single[1:]):
            v.append(conversations.apply(conversations.power(s, 0), v[-1]))
        for (s, _), after in zip(single, reversed(v)):
            e, s2 = conversations._step(s, s2, conversations._level(after))
            alone += e
        assert (edits, state) == (alone, s2)


# ---------------------------------------------------------------- shards


def fisher_yates(seed, n):
    """Inside-out Fisher-Yates with the Mersenne twister that Spark seeds."""
    rng = np.random.RandomState([(seed >> 32) & 0xFFFFFFFF, seed & 0xFFFFFFFF])

    def below(m):
        while True:
            bits = int(rng.randint(0, 2 ** 32, dtype=np.uint32)) >> 1
            if m & (m - 1) == 0:
                return (m * bits) >> 31
            if bits - bits % m + m - 1 < 2 ** 31:
                return bits % m
    out = [0] * n
    for i in range(n):
        j = below(i + 1)
        out[i] = out[j]
        out[j] = i
    return out


def plain_hash(seed, values):
    h = xxhash.xxh64(seed.to_bytes(8, "little", signed=True), seed=42).intdigest()
    for v in values:
        if v is not None:
            h = xxhash.xxh64(v.to_bytes(8, "little", signed=True), seed=h).intdigest()
        h = xxhash.xxh64(int(v is None).to_bytes(4, "little"), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def plain_shards(docs, shards, seed, buckets):
    records = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    held = defaultdict(list)
    for r, n in records.items():
        for k in range(n):
            held[plain_hash(seed, [*r, k]) % buckets].append((*r, k))
    order = []
    for b in range(buckets):
        rows = sorted(held[b], key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        order += [rows[j] for j in fisher_yates(seed + b, len(rows))]
    out, starts = [], [-(-s * len(order) // shards) for s in range(shards)]
    for place, (i, size, crc, _) in enumerate(order):
        s = place * shards // len(order)
        out.append((i, size, crc, "rows", s, place - starts[s], None))
    return out


def test_shards_against_a_plain_two_pass_shuffle(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(SF + "/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op12_external_shuffle(spark, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_shards(docs, 24, 1, sharding.MIN_BUCKETS)))


def test_shards_of_odd_and_repeated_rows(spark):
    docs = [(1, "a"), (2, None), (None, "a"), (None, None), (3, "é" * 5000), (4, "")] + [(7, "copy")] * 9000 + [(None, "x")] * 300
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("shard", "_copy", "size", "_n")})
    got = [tuple(r) for r in sharding.placements(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_shards(docs, 24, 1, sharding.MIN_BUCKETS)))
    per = Counter(r[4] for r in got)
    assert set(per) == set(range(24)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r[5] for r in got if r[4] == s) == list(range(per[s]))
    assert sharding.placements(df.where("1 = 0")).count() == 0
    assert sharding.placements(df.where("doc_id = 1")).first().slot == 0
    again = sharding.placements(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in again)
    other = [tuple(r) for r in sharding.placements(df, seed=2).collect()]
    assert sorted(map(str, other)) != sorted(map(str, got))


def test_the_order_is_near_uniform(spark):
    rows = sharding.shuffled(spark.range(20_000), seed=3, bucket_rows=100).toPandas().sort_values("_place")
    assert rows["_place"].tolist() == list(range(20_000)) and sorted(rows["id"]) == list(range(20_000))
    ids = rows["id"].to_numpy()
    assert abs(np.corrcoef(np.arange(20_000), ids)[0, 1]) < 0.03
    assert 0.97 < (np.diff(ids) > 0).mean() * 2 < 1.03


def test_written_shards_hold_the_whole_documents_in_order(spark, tmp_path):
    docs = spark.read.parquet(SF + "/documents.parquet")
    docs = docs.union(docs.where("doc_id < 5"))
    sharding.write_shards(docs, str(tmp_path / "out"), shards=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    plain = lambda df: sorted(map(str, df.select(*docs.columns).collect()))
    assert plain(back) == plain(docs)
    slots = {r._shard: sorted(r.s) for r in back.groupBy("_shard").agg(F.collect_list("_slot").alias("s")).collect()}
    assert set(slots) == set(range(5)) and all(v == list(range(len(v))) for v in slots.values())


# ---------------------------------------------------------------- fill in the middle


def plain_fim(doc_id, text, seed=1, unit="token"):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text) if unit == "token" else list(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fill_in_middle_of_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(SF + "/documents.parquet").collect()}
    got = queries.op13_fill_in_middle(spark, SF).collect()
    assert len(got) == len(docs) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        n, form, p, m, out = plain_fim(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert (r.output_sha256, r.restored_sha256) == (sha(out), sha(docs[r.doc_id] or ""))


@pytest.mark.parametrize("unit", ["token", "char"])
@pytest.mark.parametrize("block", [1, 1 << 21])
def test_fill_in_middle_of_odd_texts(spark, monkeypatch, unit, block):
    monkeypatch.setattr(fim, "BLOCK_BYTES", block)
    rng = random.Random(9)
    texts = ["", None, "é", "a", "😀", "<P>", "x<S>y", "<", "<P", "M><", "\n\r\0", "日本語 text ß😀!", "a" * 100_000, "é😀b" * 30_000, "P>S>M><" * 5]
    texts += ["".join(rng.choice("ab<PSM>é日😀 \n1") for _ in range(rng.randrange(40))) for _ in range(150)]
    rows = [(i if i % 7 else None, t, "k") for i, t in enumerate(texts)] + [(1, "twice", "k")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string")
    got = fim.transform(df, ["doc_id"], unit=unit) \
        .withColumn("back", fim.restored()).collect()
    want = Counter((i, *plain_fim(i, t, unit=unit), t or "") for i, t, _ in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == want
    assert fim.transform(df.where("1 = 0"), ["doc_id"]).count() == 0
