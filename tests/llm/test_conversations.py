"""Conversation repair against the plain recursion over all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from linkcensus.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "User", "", None, "unknown"]
TEXTS = ["Yes.", "No", "really?!", "", "  ", None, "\t\x0b", "ends. \n", "é", "é. ", "x" * 100 + "1.", "x" * 100 + "2.", "x" * 100 + "1"]
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def brute(rows):
    """rows: (turn, role, text) in order. The expected columns without conv_id."""
    faults, seen = [], set()
    for _, role, text in rows:
        core = re.sub("[\x20\x09-\x0d]+$", "", text)
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            cost, tail = best(i + 1, state)
            found.append((cost + 3, "D" + tail))
            demands = "a" if state == "u" else "u"
            if faults[i] not in ("b", "d"):
                cut = faults[i] == "t"
                if (then := NEXT.get((state, rows[i][1][:1]))) is not None:
                    cost, tail = best(i + 1, then)
                    found.append((cost + cut, "K" + tail))
                cost, tail = best(i + 1, demands)
                found.append((cost + 2 + cut, "R" + tail))
        if inserts[0] < 3:
            inserts[0] += 1
            cost, tail = best.__wrapped__(i, "a" if state == "u" else "u")
            inserts[0] -= 1
            found.append((cost + 2, "I" + tail))
        return min(found, default=(10**9, ""))

    inserts = [0]
    cost, audit = best(0, "")
    lines, state, i = [], "", 0
    for letter in audit:
        demands = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[demands]
        if letter == "I":
            lines.append(f"{name}:")
            state = demands
            continue
        _, role, text = rows[i]
        i += 1
        if letter == "K":
            lines.append(f"{role}:{text}")
            state = NEXT[state, role[:1]]
        elif letter == "R":
            lines.append(f"{name}:{text}")
            state = demands
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest


def in_order(rows):
    key = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    plain = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(plain, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2][:64].encode(), key(x[1], x[2])))


def random_rows(rng, n):
    kind = rng.random()
    rows = []
    for i in range(n):
        turn = rng.choice([i, i, i, 3 * i, None, 2]) if kind < 0.6 else i
        role = rng.choice(ROLES) if kind < 0.7 else ("user", "assistant")[i % 2]
        rows.append((turn, role, rng.choice(TEXTS) if kind < 0.8 else f"text {i}."))
    return rows


NAMES = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def found_by(rows):
    repair = conversations.repaired(rows)
    summary = {r.conv_id: r for r in repair.summary.collect()}
    digest = {r.conv_id: r.repaired_sha256 for r in conversations.digests(repair.rows).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {c: (*(r[n] for n in NAMES[:-1]), digest.get(c, empty)) for c, r in summary.items()}


@pytest.mark.parametrize("chunk", [1, 2, 7, 256])
def test_chunks_converge_to_the_costs_of_one_pass(chunk):
    rng = np.random.default_rng(chunk)
    for _ in range(30):
        sizes = rng.integers(1, 60, rng.integers(1, 6))
        codes = np.concatenate([
            rng.choice([0, 1, 2, 3, 5, 6, 8, 17], n) if rng.random() < 0.5 else np.resize([1, 2], n) for n in sizes
        ]).astype("uint8")
        ends = np.where(rng.random((len(sizes), 1)) < 0.5, conversations.FINAL, np.array([2, 2, 0, 2]))
        got, at = conversations.backward(codes, sizes, ends, chunk), 0
        for n, end in zip(sizes, ends, strict=True):
            vector = end[None]
            for i in range(at + n - 1, at - 1, -1):
                vector = conversations._step(vector, codes[i : i + 1].astype("int64"))
                assert got[i].tolist() == vector[0].tolist()
            at += n


def test_equals_the_recursion(spark):
    rng = random.Random(11)
    given = {c: random_rows(rng, rng.choice([1, 2, 3, 5, 8, 20])) for c in [None, *range(150)]}
    rows = [(c, *r, "own") for c, own in given.items() for r in own]
    rng.shuffle(rows)
    got = found_by(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.keys() == given.keys()
    for conv, own in given.items():
        assert got[conv] == brute(in_order(own)), (conv, in_order(own))


def test_long_conversations_over_several_tasks(spark, monkeypatch):
    """Pieces of one conversation in many tasks, guesses that need several passes, and copies."""
    rng = random.Random(3)
    given = {
        7: [(i, ("user", "assistant")[i % 2], f"{i}.") for i in range(1200) if i not in (401, 777)],
        8: [(None, "user", "same.")] * 500 + [(i, rng.choice(ROLES), rng.choice([f"{i}", "a.", f"{i}!"])) for i in range(700)],
        9: [(1, "user", "x.")],
    }
    rows = [(c, *r, None) for c, own in given.items() for r in own]
    rng.shuffle(rows)
    passes = []
    plain = conversations._of_pieces
    monkeypatch.setattr(conversations, "_of_pieces", lambda p, places, *a: passes.append(len(places)) or plain(p, places, *a))
    monkeypatch.setattr(conversations, "TASK_ROWS", 120)
    got = found_by(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert len(passes) >= 2 and passes[0] > 8
    monkeypatch.undo()
    import sys
    sys.setrecursionlimit(20_000)
    for conv, own in given.items():
        assert got[conv] == brute(in_order(own)), conv


def test_extreme_turns_and_nothing(spark):
    rows = [(1, -(2**63), "user", "a.", ""), (1, 2**63 - 1, "assistant", "b.", ""), (2, None, None, None, None)]
    got = found_by(spark.createDataFrame(rows, SCHEMA))
    assert got[1][0] is None and got[1][6] == "KK" and got[2][:7] == (0, 1, 0, 0, 0, 3, "D")
    assert found_by(spark.createDataFrame([], SCHEMA)) == {}


def test_query_over_damaged_rows(spark, tmp_path):
    rng = random.Random(5)
    given = {c: random_rows(rng, rng.choice([1, 1, 2, 6, 9])) for c in [None, *range(60)]}
    rows = [(c, *r, "own") for c, own in given.items() for r in own]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op11_parallel_viterbi(spark, str(tmp_path))
    assert found.columns == ["conv_id", *NAMES]
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"] * 2
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    assert got.keys() == given.keys()
    dropped = 0
    for conv, own in given.items():
        after = []
        for turn, role, text in own:
            role, text = (" " if x is None else x for x in (role, text))
            key = ":".join(" " if x is None else str(x) for x in (conv, turn))
            fault = zlib.crc32(key.encode()) % 20
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            after += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        dropped += not after
        assert got[conv] == brute(in_order(after)), conv
    assert dropped
