"""Repair of conversations: the cheapest edits that make turns alternate, by a parallel Viterbi.

Rows of a conversation are taken by turn. Edits: Keep (0), Rerole to user or assistant (2),
Delete (3, and the only one for blank and repeated rows), Insert an empty turn of the user or
assistant (2); a truncated row that stays adds 1. The roles that remain must be a system turn at
most, then turns of user and assistant in pairs, or nothing. Of the cheapest edits, those whose
initials (D, I, K, R) come first in ASCII order are taken.

The states of the repaired roles so far are 0 nothing, 1 system, 2 user (an assistant must follow),
3 assistant. The cost to go from each state is a vector of four numbers that each row
maps to the one before it. Rows are range-partitioned by conversation and turn, so that a
conversation of any length is cut into pieces. Inside a task, pieces are cut into chunks that
numpy takes a row of each at a time, from right to left, all at once: a chunk starts from a vector
guessed by the row that follows. Fix-up passes rerun a chunk whose true vector differs from the guess by more than
a constant, and only until the vectors they give differ from the earlier ones by a constant.
The constants are added up in the end, which stitches the costs. Pieces of
one conversation in several tasks are treated in the same way, by passes of small Spark jobs over
those pieces alone, of which there are two for each task at most.

With all costs known, tracing goes from left to right and takes the first initial that is on a
cheapest way. Where a conversation has several pieces, their ends for all four states are
found first, and composed.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcensus.llm.common import stored

CHUNK_ROWS = 256  # that one lane takes
TASK_ROWS = 500_000  # distinct rows of a task, where there are more than for the usual number of tasks
PREFIX_CHARS = 64
DELETE, INSERT, KEEP, REROLE = (ord(c) for c in "DIKR")
TRUNCATED, BLANK, DUPLICATE = 4, 8, 16  # added to a row's code, 0 to 3 for s, u, a and any other initial
_OTHER = 3
_SPACES = " \t\n\x0b\x0c\r"
#: State after a turn of the user or assistant that a state demands, and which of the two.
_EMIT = np.array([2, 2, 3, 2])
_DEMANDS = np.array(["user", "user", "assistant", "user"], dtype=object)
_KEY_BYTES = 32
_FAR = np.int64(1) << 40
#: Costs when all rows are done.
FINAL = np.array([0, 4, 2, 0], dtype="int64")

_PIECES = (
    "part int, seq int, conv_id long, codes binary, keys binary, first_initial int, last_initial int, first_turn long, last_turn long,"
    " distinct_turns long, illegal long, blank long, duplicate long, truncated long"
)
_TRACED = "part int, seq int, conv_id long, audit string, cost long, keys array<binary>, roles array<string>"


class Repair(NamedTuple):
    """summary: a row per conversation; rows: the repaired turns."""

    summary: DataFrame
    rows: DataFrame


def _step(after: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Costs to go before rows with these codes, from those after them; one line for each row."""
    plain = _without_insert(after, codes)
    user = np.minimum(plain[:, 2], 2 + plain[:, 3])
    return np.stack(
        [np.minimum(plain[:, 0], 2 + user), np.minimum(plain[:, 1], 2 + user), user, np.minimum(plain[:, 3], 2 + plain[:, 2])], axis=1
    )


def _edits(after: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs to go, from each state, if the row is deleted, kept or reroled."""
    initial = codes & 3
    stays = np.where(codes & (BLANK | DUPLICATE), _FAR, (codes & TRUNCATED) // TRUNCATED)[:, None]
    kept = np.full(after.shape, _FAR)
    for state, letter, then in ((0, 0, 1), (0, 1, 2), (1, 1, 2), (3, 1, 2), (2, 2, 3)):
        here = initial == letter
        kept[here, state] = after[here, then]
    return 3 + after, kept + stays, 2 + after[:, _EMIT] + stays


def _without_insert(after: np.ndarray, codes: np.ndarray) -> np.ndarray:
    deleted, kept, reroled = _edits(after, codes)
    return np.minimum(np.minimum(deleted, kept), reroled)


def _guess(codes: np.ndarray) -> np.ndarray:
    """Vectors for chunks that are followed by rows with these codes."""
    demands = np.array([[0, 0, 0, 0], [0, 0, 2, 0], [2, 2, 0, 2], [0, 0, 0, 0]], dtype="int64")
    return demands[codes & 3]


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines differ by a constant."""
    d = a - b
    return (d == d[:, :1]).all(axis=1)


def backward(codes: np.ndarray, sizes: np.ndarray, ends: np.ndarray, chunk: int = CHUNK_ROWS) -> np.ndarray:
    """Costs to go before every row of pieces of these sizes (none of them 0), given the vectors at their ends."""
    codes = codes.astype("int64")
    stop, lanes = np.cumsum(sizes), -(-sizes // chunk)
    piece = np.repeat(np.arange(len(sizes)), lanes)
    low = (stop - sizes)[piece] + chunk * (np.arange(len(piece)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    high = np.minimum(low + chunk, stop[piece])
    last = high == stop[piece]
    end = np.empty((len(piece), 4), dtype="int64")
    end[last] = ends
    end[~last] = _guess(codes[high[~last]])
    out = np.empty((len(codes), 4), dtype="int64")
    run, again = np.arange(len(piece)), False
    while len(run):
        vector, active = end[run], run
        for t in itertools.count(1):
            row = high[active] - t
            vector = _step(vector, codes[row])
            goes_on = row > low[active]
            if again:
                same = _alike(vector, out[row])
                for lane, r, shift in zip(active[same], row[same], (vector - out[row])[same, 0], strict=True):
                    out[r + 1 : high[lane]] -= shift  # what was found anew takes the constant of the rest
                    end[lane] -= shift
                goes_on &= ~same
                out[row[~same]] = vector[~same]
            else:
                out[row] = vector
            vector, active = vector[goes_on], active[goes_on]
            if not len(active):
                break
        inner = np.flatnonzero(~last)
        run = inner[~_alike(end[inner], out[high[inner]])]
        end[run] = out[high[run]]
        again = True
    for lane in np.flatnonzero(~last)[::-1].tolist():
        out[low[lane] : high[lane]] += out[high[lane], 0] - end[lane, 0]
    return out


def _choices(codes: np.ndarray, costs: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row and state: how many turns are inserted before it, its own edit, and the state after it."""
    codes = codes.astype("int64")
    deleted, kept, _ = _edits(after, codes)
    choice = np.where(costs == deleted, DELETE, np.where(costs == 2 + costs[:, _EMIT], INSERT, np.where(costs == kept, KEEP, REROLE)))
    state = np.broadcast_to(np.arange(4), choice.shape)
    inserted = np.zeros(choice.shape, dtype="int64")
    row = np.arange(len(codes))[:, None]
    for _ in range(2):
        inserts = choice[row, state] == INSERT
        inserted += inserts
        state = np.where(inserts, _EMIT[state], state)
    edit = choice[row, state]
    kept_state = np.array([1, 2, 3, 0])[codes & 3][:, None]
    return inserted, edit, np.where(edit == DELETE, state, np.where(edit == KEEP, kept_state, _EMIT[state]))


def _walk(then: bytes, state: int) -> Iterator[int]:
    """The state before each row; `then` has four states for each row."""
    for at in range(0, len(then), 4):
        yield state
        state = then[at + state]


def trace(codes: np.ndarray, costs: np.ndarray, after: np.ndarray, state: int, ends: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the least audit from this state; and per letter the row (-1: inserted) and the role given ("" where it keeps its own).

    ends: whether the conversation ends after these rows.
    """
    inserted, edit, then = _choices(codes, costs, after)
    states = np.fromiter(_walk(then.astype("uint8").tobytes(), state), "int64", len(codes))
    row = np.arange(len(codes))
    n, own = inserted[row, states], edit[row, states]
    final = int(then[-1, states[-1]]) if len(codes) else state
    more = {1: 2, 2: 1}.get(final, 0) if ends else 0
    at = np.cumsum(n + 1) - 1
    letters = np.full(len(codes) + int(n.sum()) + more, INSERT, dtype="uint8")
    letters[at] = own
    rows = np.full(len(letters), -1, dtype="int64")
    rows[at] = row
    # the state before each letter: that before the row, or after the turns inserted before it
    owner = np.repeat(row, n + 1)
    nth = np.arange(len(owner)) - np.repeat(at - n, n + 1)
    before = states[owner]
    before = np.where(nth > 0, _EMIT[before], before)
    before = np.where(nth > 1, _EMIT[before], before)
    for _ in range(more):
        before, final = np.append(before, final), int(_EMIT[final])
    roles = np.where((letters == INSERT) | (letters == REROLE), _DEMANDS[before], "")
    return letters, rows, roles


def _cost(codes: np.ndarray, letters: np.ndarray, rows: np.ndarray) -> int:
    stay = rows[(letters == KEEP) | (letters == REROLE)]
    price = np.zeros(256, dtype="int64")
    price[[DELETE, INSERT, REROLE]] = 3, 2, 2
    return int(price[letters].sum() + ((codes[stay] & TRUNCATED) > 0).sum())


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows in light form: conv_id, turn, role, prefix, key, n (copies), blank, cut, first (of its role and text)."""
    trimmed = F.rtrim("text", F.lit(_SPACES))
    light = rows.select(
        "conv_id", "turn", "role", "key", F.substring("text", 1, PREFIX_CHARS).alias("prefix"), (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(*".!?")).alias("cut"),
    )
    runs = light.groupBy("conv_id", "turn", "role", "prefix", "key").agg(
        F.count(F.lit(1)).alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut")
    )
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = runs.groupBy("conv_id", "key").agg(F.min(order).alias("at")).select(
        F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), F.col("at.turn").alias("_turn"), F.lit(True).alias("_first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")) & F.col("turn").eqNullSafe(F.col("_turn"))
    return runs.join(firsts, same, "left").withColumn("first", F.col("_first").isNotNull()).drop("_conv", "_key", "_turn", "_first")


def _pieces(light: DataFrame) -> DataFrame:
    """What each task has of each conversation, as codes of its rows and keys of those that may stay."""
    spark = light.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-light.count() // TASK_ROWS))
    order = ["conv_id", "turn", "role", "prefix", "key"]
    ordered = light.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), itertools.count(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch["conv_id"]
            number, known = conv.fill_null(0).to_numpy(), conv.is_valid().to_numpy(zero_copy_only=False)
            new = np.flatnonzero((number[1:] != number[:-1]) | (known[1:] != known[:-1])) + 1
            out = []
            for a, b in itertools.pairwise([0, *new.tolist(), batch.num_rows]):
                if held and held[0]["conv_id"][0].as_py() != conv[a].as_py():
                    out.append(_piece(held, part, next(seq)))
                    held = []
                held.append(batch.slice(a, b - a))
            if out:
                yield _batch(out, _PIECES)
        if held:
            yield _batch([_piece(held, part, next(seq))], _PIECES)

    return ordered.mapInArrow(cut, _PIECES)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _piece(batches: list[pa.RecordBatch], part: int, seq: int) -> tuple:
    rows = pa.Table.from_batches(batches)
    n, blank, cut, first = (rows[c].to_numpy() for c in ("n", "blank", "cut", "first"))
    initial = np.array(["sua".find(r[:1]) if r else _OTHER for r in rows["role"].to_pylist()], dtype="int64") & 3
    copy = np.where(blank, BLANK, DUPLICATE)
    own = initial + np.where(blank, BLANK, np.where(first, np.where(cut, TRUNCATED, 0), DUPLICATE))
    codes = np.repeat(initial + copy, n)
    codes[np.cumsum(n) - n] = own
    keys = b"".join(k for k, stays in zip(rows["key"].to_pylist(), (first & ~blank).tolist(), strict=True) if stays)
    initials = codes & 3
    legal = np.isin(initials[:-1] * 4 + initials[1:], [1, 4 + 2, 8 + 1])  # su, ua, au
    turns = [t for t in rows["turn"].to_pylist() if t is not None]
    faults = [int(((codes & bit) > 0).sum()) for bit in (BLANK, DUPLICATE, TRUNCATED)]
    return (
        part, seq, rows["conv_id"][0].as_py(), codes.astype("uint8").tobytes(), keys, int(initials[0]), int(initials[-1]),
        turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), int((~legal).sum()), *faults,
    )


class _Piece(NamedTuple):
    """A piece that shares its conversation with others: its place, and what lies next to it."""

    place: tuple[int, int]
    first_initial: int
    last_initial: int
    first_turn: int | None
    last_turn: int | None


def _chains(pieces: DataFrame) -> list[list[_Piece]]:
    """The pieces of each conversation that several tasks have; a task has two of them at most."""
    light = F.struct("seq", "conv_id", "first_initial", "last_initial", "first_turn", "last_turn")
    ends = pieces.groupBy("part").agg(F.min(light).alias("a"), F.max(light).alias("b")).orderBy("part").collect()
    listed = [(r.part, x) for r in ends for x in ([r.a, r.b] if r.a.seq != r.b.seq else [r.a])]
    chains = []
    for _, group in itertools.groupby(listed, key=lambda x: x[1].conv_id):
        chain = [_Piece((part, x.seq), *x[2:]) for part, x in group]
        if len(chain) > 1:
            chains.append(chain)
    return chains


def _of_pieces(pieces: DataFrame, places: dict[tuple[int, int], list], more: str, of: Callable, schema: str) -> list:
    """`of` for each of the places, few rows, with the values that belong to it."""
    spark = pieces.sparkSession
    wanted = spark.createDataFrame([(*place, *values) for place, values in places.items()], f"part int, seq int, {more}")
    names = [c.split()[0] for c in more.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = np.frombuffer(row["codes"], "uint8")
                yield _batch([(row["part"], row["seq"], *of(codes, *(row[n] for n in names)))], f"part int, seq int, {schema}")

    found = pieces.select("part", "seq", "codes").join(F.broadcast(wanted), ["part", "seq"]).mapInArrow(run, f"part int, seq int, {schema}")
    return found.collect()


def _fixed_up(pieces: DataFrame, chains: list[list[_Piece]]) -> dict[tuple[int, int], list[int]]:
    """The true vector, but for a constant, at the end of each piece of the chains."""
    end = {}
    for chain in chains:
        end[chain[-1].place] = FINAL.tolist()
        for piece, after in itertools.pairwise(chain):
            end[piece.place] = _guess(np.array([after.first_initial]))[0].tolist()

    def first(codes: np.ndarray, vector: list[int]) -> tuple[list[int]]:
        start = backward(codes, np.array([len(codes)]), np.array([vector]))[0]
        return ((start - start.min()).tolist(),)

    start: dict[tuple[int, int], list[int]] = {}
    run = dict(end)
    while run:
        for r in _of_pieces(pieces, {p: [v] for p, v in run.items()}, "vector array<long>", first, "start array<long>"):
            start[r.part, r.seq] = r.start
        run = {}
        for chain in chains:
            for piece, after in itertools.pairwise(chain):
                if not _alike(np.array([end[piece.place]]), np.array([start[after.place]]))[0]:
                    run[piece.place] = end[piece.place] = start[after.place]
    return end


def _entered(pieces: DataFrame, chains: list[list[_Piece]], end: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], int]:
    """The state in which tracing enters each piece of the chains."""

    def exits(codes: np.ndarray, vector: list[int]) -> tuple[list[int]]:
        costs = backward(codes, np.array([len(codes)]), np.array([vector]))
        then = _choices(codes, costs, np.concatenate([costs[1:], [vector]]))[2].astype("uint8")
        last = then[-1]
        return ([int(last[list(_walk(then.tobytes(), s))[-1]]) for s in range(4)],)

    found = _of_pieces(pieces, {p: [v] for p, v in end.items()}, "vector array<long>", exits, "exits array<long>")
    leaves = {(r.part, r.seq): r.exits for r in found}
    state = {}
    for chain in chains:
        at = 0
        for piece in chain:
            state[piece.place] = at
            at = leaves[piece.place][at]
    return state


def _traced(pieces: DataFrame, chains: list[list[_Piece]]) -> DataFrame:
    end = _fixed_up(pieces, chains) if chains else {}
    state = _entered(pieces, chains, end) if chains else {}
    last = {chain[-1].place for chain in chains}
    listed = [(*p, v, state[p], p in last) for p, v in end.items()]
    known = pieces.sparkSession.createDataFrame(listed, "part int, seq int, vector array<long>, state int, last boolean")
    rows = pieces.select("part", "seq", "conv_id", "codes", "keys").join(F.broadcast(known), ["part", "seq"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            given = batch.to_pylist()
            codes = [np.frombuffer(r["codes"], "uint8") for r in given]
            sizes = np.array([len(c) for c in codes])
            ends = np.array([r["vector"] or FINAL.tolist() for r in given], dtype="int64")
            costs = backward(np.concatenate(codes), sizes, ends)
            upto, out = 0, []
            for r, own, vector in zip(given, codes, ends, strict=True):
                here = costs[upto : upto + len(own)]
                upto += len(own)
                letters, at, roles = trace(own, here, np.concatenate([here[1:], [vector]]), r["state"] or 0, r["last"] is not False)
                place = np.cumsum((own & (BLANK | DUPLICATE)) == 0) - 1  # of each row among those that have a key
                stays = np.flatnonzero(letters != DELETE).tolist()
                keys = [r["keys"][k : k + _KEY_BYTES] if x >= 0 else None for x, k in ((at[i], _KEY_BYTES * place[at[i]]) for i in stays)]
                out.append((
                    r["part"], r["seq"], r["conv_id"], letters.tobytes().decode(), _cost(own, letters, at), keys, [roles[i] or None for i in stays],
                ))
            yield _batch(out, _TRACED)

    return rows.mapInArrow(run, _TRACED)


def repaired(conversations: DataFrame) -> Repair:
    """`conversations` (conv_id long, turn long, role, text) with the cheapest edits made.

    summary: conv_id, gaps (highest turn - lowest + 1 - distinct turns; null beyond 64 bits), blank, duplicate and truncated (rows by
    their first fault), illegal (neighbouring roles whose initials are not su, ua or au), cost, audit (initials of the edits).
    rows: conv_id, position (ascending in a conversation), role, text.

    A null role or text is one space. Rows of a turn, null turns first, are taken by role, then by the
    first 64 characters of the text, then by its hash; copies of a row stand together. A null conv_id is a
    conversation of its own. Role initials other than s, u and a are never kept. Other columns are left out. An
    empty table gives empty results. The audit of a conversation is one string.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    rows = rows.withColumn("key", F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)))
    pieces = stored(_pieces(marked(rows)), "conversation-pieces")
    chains = _chains(pieces)
    traced = stored(_traced(pieces, chains), "conversation-edits")

    joints = [
        (*b.place, int((a.last_initial * 4 + b.first_initial) not in (1, 6, 9)), int(a.last_turn is not None and a.last_turn == b.first_turn))
        for chain in chains
        for a, b in itertools.pairwise(chain)
    ]
    joined = pieces.sparkSession.createDataFrame(joints, "part int, seq int, joint_illegal long, joint_turn long")
    none = F.lit(0)
    counted = pieces.drop("codes", "keys").join(F.broadcast(joined), ["part", "seq"], "left").join(traced.select("part", "seq", "audit", "cost"), ["part", "seq"])
    wide = "DECIMAL(20, 0)"
    sums = counted.groupBy("conv_id").agg(
        F.min("first_turn").alias("low"), F.max("last_turn").alias("high"),
        F.sum(F.col("distinct_turns") - F.coalesce("joint_turn", none)).alias("turns"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + F.coalesce("joint_illegal", none)).alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x.audit), "").alias("audit"),
    )
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.expr(f"try_cast(CAST(high AS {wide}) - CAST(low AS {wide}) + 1 - turns AS BIGINT)"))
    summary = sums.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    # One row of each role and text of a conversation is left at most, so its key finds it.
    place = F.shiftleft(F.col("part").cast("long"), 40)
    edits = traced.select("conv_id", "part", F.posexplode(F.arrays_zip("keys", "roles")).alias("at", "edit")).select(
        "conv_id", (place + F.col("at")).alias("position"), F.col("edit.keys").alias("key"), F.col("edit.roles").alias("new_role")
    )
    texts = rows.groupBy("conv_id", "key").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    texts = texts.select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), "role", "text")
    stay = edits.filter("key IS NOT NULL").join(texts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")))
    stay = stay.select("conv_id", "position", F.coalesce("new_role", "role").alias("role"), "text")
    added = edits.filter("key IS NULL").select("conv_id", "position", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return Repair(summary, stay.unionByName(added))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows: of `role:text` in order, joined by line feeds.

    A digest is a function of the whole in order, so one task reads a conversation's repaired rows, as a stream.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield _batch(done, "conv_id long, repaired_sha256 string")
        if digest is not None:
            yield _batch([(now, digest.hexdigest())], "conv_id long, repaired_sha256 string")

    by_conversation = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return by_conversation.select("conv_id", "role", "text").mapInArrow(hashed, "conv_id long, repaired_sha256 string")
