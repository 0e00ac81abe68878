"""Conversation repair: against a search over all edits, and whole tables against SQL."""

import hashlib
import heapq
import random

import duckdb
import pytest

from lumiframe.llm import conversation as C

ROWS = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def slow(turns):
    """(cost, audit, lines) by Dijkstra's search over (turn, state); ``turns``: (role, text) in order."""
    faults, seen = [], set()
    for role, text in turns:
        mean = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not mean else "dup" if (role, text) in seen else "cut" if mean[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, k, state, lines = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(turns) and state in (0, 3):
            return cost, audit, list(lines), faults
        for role in ("user", "assistant"):
            if (to := NEXT.get((state, role[0]))) is not None:
                heapq.heappush(heap, (cost + 2, audit + "I", k, to, (*lines, f"{role}:")))
        if k < len(turns):
            role, text = turns[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, state, lines))
            if faults[k] in ("", "cut"):
                more = faults[k] == "cut"
                if (to := NEXT.get((state, role[:1]))) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, to, (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (to := NEXT.get((state, new[0]))) is not None:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", k + 1, to, (*lines, f"{new}:{text}")))


def made(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", ""]), rng.choice(["Yes.", "No", "", "Why?", " \t", "So!\n", f"Text {rng.random()}.", f"cut {rng.random()}"])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_edits_are_the_cheapest(seed):
    turns = made(seed, seed % 9)
    cost, audit, lines, faults = slow(turns)
    kinds = [(role[:1] if role[:1] in ("s", "u", "a") else "?", {"": C.SOUND, "blank": C.BLANK, "dup": C.DUPLICATE, "cut": C.CUT}[f]) for (role, _), f in zip(turns, faults, strict=True)]
    m = C.times(C.CLOSURE, C.product([C.TURNS[k] for k in kinds]))
    assert min(m[j] for j in C.END if m[j]) == (cost, audit)


def test_products_are_associative():
    rng = random.Random(5)
    ms = [C.TURNS[rng.choice(list(C.TURNS))] for _ in range(200)]
    left = C.ONE
    for m in ms:
        left = C.times(left, m)
    assert left == C.product(ms) == C.times(C.product(ms[:70]), C.product(ms[70:]))


@pytest.mark.parametrize(("leaf", "fan"), [(512, 16), (2, 2), (3, 4)])
def test_repair_against_the_search(spark, monkeypatch, leaf, fan):
    """Conversations of up to 150 turns in blocks of 2 and more, several levels deep, against the search of each."""
    monkeypatch.setattr(C, "LEAF", leaf)
    monkeypatch.setattr(C, "FAN", fan)
    convs = {k: made(k, n) for k, n in enumerate([1, 2, 3, 5, 8, 13, 40, 150])}
    rows = [(k, t, *x) for k, turns in convs.items() for t, x in enumerate(turns)]
    random.Random(1).shuffle(rows)
    report, turns = C.assess_and_repair(spark.createDataFrame(rows, ROWS).repartition(5))
    got = {r.conv_id: r for r in report.collect()}
    sha = {r.conv_id: r.sha256 for r in C.digests(turns).collect()}
    assert got.keys() == convs.keys()
    for k, x in convs.items():
        cost, audit, lines, faults = slow(x)
        r = got[k]
        assert (r.cost, r.audit, r.blank, r.duplicate, r.truncated) == (cost, audit, faults.count("blank"), faults.count("dup"), faults.count("cut"))
        first = [role[:1] for role, _ in x]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        assert sha.get(k, hashlib.sha256(b"").hexdigest()) == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    texts = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.pos, r.k)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert texts == {k: slow(x)[2] for k, x in convs.items() if slow(x)[2]}


def test_edges(spark):
    """Nulls in every column, repeated rows, null and clashing columns, a very long text, an empty table."""
    rows = [(None, None, None, None, 1), (None, 1, "user", "Hi.", 1), (1, None, "user", "Hi.", 2), (1, None, "user", "Hi.", 2), (1, 7, "assistant", "x" * 300_000 + " " * 300_000, 3), (2, 4, None, None, 4), (3, 2, "user", "No.", 5), (3, 9, "user", "No more.", 5)]
    df = spark.createDataFrame(rows, ROWS + ", pos int").withColumnRenamed("pos", "block")
    report, turns = C.assess_and_repair(df)
    got = {r.conv_id: r for r in report.collect()}
    assert (got[None].blank, got[None].cost, got[None].audit) == (1, 5, "DKI")
    assert (got[1].duplicate, got[1].truncated, got[1].cost, got[1].audit, got[1].gaps) == (1, 1, 4, "KDK", 0)
    assert (got[2].blank, got[2].audit, got[2].cost) == (1, "D", 3)
    assert (got[3].gaps, got[3].illegal, got[3].cost) == (6, 1, 2) and got[3].audit == "KR"
    assert {r.conv_id for r in C.digests(turns).collect()} == {None, 1, 3}
    empty = C.assess_and_repair(df.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_query_against_sql(spark, tmp_path):
    rows = [(c, t, *x) for c in range(60) for t, x in enumerate(made(c, c % 7 + 1))] + [(None, None, "user", "Hi."), (5, None, None, None), (61, 3, "user", "Yes."), (61, 3, "user", "Yes.")]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.execute(C.oracle_sql()).fetchall(), key=str)
    assert sorted(map(tuple, C.op11_conversation_repair(spark, str(tmp_path)).collect()), key=str) == want
