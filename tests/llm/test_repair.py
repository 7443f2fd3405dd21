"""Conversation repair against a plain search over edits."""

from __future__ import annotations

import hashlib
import random
import zlib
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from logwarden.llm import repair
from logwarden.llm.repair import SYMBOLS, Rope, cheapest, re_pair, sequence_matrices

WHITE = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """Cheapest edits of ``(role, text, fault)`` rows by uniform-cost search: cost, audit, repaired rows."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, out = heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit, list(out)
        for name in ("user", "assistant"):
            if (state, name[0]) in step:
                heappush(heap, (cost + 3, audit + "I", at, step[state, name[0]], (*out, (name, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (state, role[:1]) in step:
                    heappush(heap, (cost + more, audit + "K", at + 1, step[state, role[:1]], (*out, (role, text))))
                for name in ("user", "assistant"):
                    if (state, name[0]) in step:
                        heappush(heap, (cost + 3 + more, audit + "R", at + 1, step[state, name[0]], (*out, (name, text))))
    raise AssertionError


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(WHITE)
        if not shown:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute(conversations, damage=True):
    """The contract, row by row: ``conv_id`` to the tuple of results."""
    kept = {}
    for conv, turn, role, text in conversations:
        own = kept.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        own += [(turn is not None, turn or 0, digest, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in kept.items():
        own.sort()
        rows = faults_of([r[3:] for r in own])
        turns = {r[1] for r in own if r[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        count = {name: sum(r[2] == name for r in rows) for name in ("blank", "duplicate", "truncated")}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, repaired = plain_edits(rows)
        text = "\n".join(f"{role}:{text}" for role, text in repaired)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_registered_query_equals_plain_search(spark, sf_dir):
    from logwarden.llm.registry import registered

    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = result(registered()["op12_conversation_repair"](spark, sf_dir))
    assert got == brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()])
    assert len(got) == table.select("conv_id").distinct().count()


def random_rows(seed, n_conversations=60, longest=14):
    draw = random.Random(seed)
    rows = []
    for conv in range(n_conversations):
        for turn in range(draw.randrange(longest)):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "s"])
            text = draw.choice(["Hi.", "Hi", "", " \n", "Why?", f"t{draw.randrange(9)}!", "é…", "x. ", None, "a\nb.\t"])
            rows.append((conv, draw.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("parts", [1, 7])
def test_random_conversations(spark, seed, parts):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    assert result(repair.repair_digests(repair.damaged(df))) == brute(rows)


def test_awkward_rows_and_clashing_columns(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "x."), (1, 5, "user", "same."), (1, 5, "user", "same."), (1, 9, "user", "same."),
        (2, None, "", ""), (3, 0, "assistant", "word " * 50_000 + "."), (3, 1, "user", "Ω" * 9 + "!"), (-4, -3, "system", "s."), (-4, 2, "user", "u"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("copies", "n", "first", "kind", "audit", "digest", "part"):
        df = df.withColumn(name, F.lit("z"))
    assert result(repair.repair_digests(repair.conversation_rows(df))) == brute(rows, damage=False)
    assert result(repair.repair_digests(repair.damaged(df))) == brute(rows)
    turns = sorted((r["conv_id"] or 0, r["place"], r["role"], r["text"][:9], r["edit"]) for r in repair.repaired_rows(repair.conversation_rows(df)).collect())
    assert [t for t in turns if t[0] == 1] == [(1, 0, "user", "same.", "K"), (1, 1, "assistant", "", "I")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_digests(repair.damaged(df)).collect() == []
    assert repair.repaired_rows(repair.conversation_rows(df)).collect() == []


def test_dropped_conversation_keeps_its_row(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(7, turn, "user", "x.")], "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert result(repair.repair_digests(repair.damaged(df))) == {7: (0, 0, 0, 0, 0, 0, "", empty)}


def test_hot_conversation_is_cut_over_tasks(spark):
    """A conversation of most rows, cut into many ranges and small grammars, against the plain search."""
    draw = random.Random(5)
    rows = [(1, t, draw.choice(["user", "assistant", "user", "system"]), draw.choice(["Yes.", "No", "", f"n{t}.", f"m{t}"])) for t in range(900)]
    rows += [(1, 40, "user", "copy.")] * 300 + [(c, t, "user", f"{t}.") for c in (0, 2, 3) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9)
    given = repair.conversation_rows(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one task
    try:
        parts = repair._pieces(repair.with_faults(given)).where("conv_id = 1").select("part").distinct().count()
        assert parts > 3
        assert result(repair.repair_digests(given)) == brute(rows, damage=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_matrices_of_pieces_fold_to_the_whole():
    draw = random.Random(3)
    symbols = bytes(draw.randrange(9) for _ in range(400))
    whole = sequence_matrices([symbols])[0]
    row = repair.IDENTITY[0]
    for at in range(0, 400, 37):
        row = repair.times_row(row, sequence_matrices([symbols[at : at + 37]])[0])
    assert cheapest(whole[0]) == cheapest(row)


@pytest.mark.parametrize("seed", range(6))
def test_grammar_expands_to_its_sequences(seed):
    draw = random.Random(seed)
    sequences = [bytes(draw.choices(range(9), weights=[9, 9, 9, 1, 1, 1, 1, 1, 3], k=draw.randrange(80))) for _ in range(20)]
    sequences += [b"", b"\0" * 50, b"\0\1" * 40]
    rules, compressed = re_pair(sequences)

    def expand(symbol):
        if symbol < len(SYMBOLS):
            return [symbol]
        left, right = rules[symbol - len(SYMBOLS)]
        return expand(left) + expand(right)

    assert [bytes(x for s in c for x in expand(s)) for c in compressed] == sequences
    pairs = [p for c in compressed for p in zip(c, c[1:], strict=False) if p[0] != p[1]]
    assert len(pairs) == len(set(pairs))


def test_ropes_compare_as_their_bytes():
    draw = random.Random(8)
    ropes = [Rope(bytes(draw.choices(b"DIK", k=draw.randrange(4)))) for _ in range(12)]
    for _ in range(200):
        ropes.append(draw.choice(ropes) + draw.choice(ropes))
        if ropes[-1].size > 400:
            ropes.pop()
    for _ in range(2000):
        a, b = draw.choice(ropes), draw.choice(ropes)
        assert (a < b) == (bytes(a) < bytes(b))
        assert (a.digest == b.digest and a.size == b.size) == (bytes(a) == bytes(b))
