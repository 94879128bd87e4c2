"""Contains-any for lists that no task can hold: an equi join on anchors.

Every term is anchored at one window of its bytes, as wide as the largest power of two that
fits in, so half of the term at least: of eight windows, evenly spaced, the one that the fewest
windows of the list share. The texts are scanned once. A bit map of the anchors, of
bounded size and without false negatives, says at which bytes a term may lie; a row is passed on
for each of those, with the window's hash and the bytes around it, as many as the terms of that width
can reach. Before that a second map is asked for the whole term: its first and last window, which
together cover it, and its size, for each place and size that the list has (where it has few). What
passes both is nearly always a term. It joins the anchors on the hash, and the term is compared with those bytes. So no
text goes through a shuffle, all comparisons run in parallel, and a row that several
terms hit is kept once.

A LIKE pattern is anchored in its longest literal segment. The wildcards may reach any part of a text,
so texts with candidates of patterns travel whole, but each once: the pairs of a row's number and a
pattern are found by the join without it, and meet the text by that number. Where any term will do, rows that
hold a literal have no pairs, and texts without a pair stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from linkcensus.functions.multipattern import like_regex, lower_bytes, segments
from linkcensus.functions.windows import mixed, widest, window_hashes
from linkcensus.operators.staging import Staging

MOST_BITS = 28  # of a bit map: 32 MB
BITS_EACH = 32  # of a bit map for each hash, up to there; twice as many at most
FALSE = 1e-5  # of windows that are no anchor, the share that a bit map may let pass
PIECE_BITS = 19  # of a piece of a bit map, made in one place: 64 KB
MOST_SHAPES = 256  # places and sizes of the terms of a width (all of them up to 32 bytes), up to which whole terms are looked for
POSITIONS = 8  # windows of a term that may become its anchor
SKETCH_BITS = 18  # slots in which windows of the list are counted: 2 MB
BLOCK = 1 << 18  # bytes of text hashed at a time
BATCH_ROWS = 1 << 14  # candidates passed on at a time
WHOLE_BYTES = 16 << 20  # or so much of the texts that go with candidates of patterns
_SIZED = 0xD6E8FEB86659FD93  # odd
_PROBES = (1, *(0x9E3779B97F4A7C15 * (2 * k + 1) * (2 * k + 1) % (1 << 64) for k in range(7)))  # odd
_WINDOWS = "match_term string, segment binary, pattern string, width int, place int, hash long, ends long"


def anchors_of(terms: DataFrame, wildcards: bool) -> DataFrame:
    """One row per distinct term with a literal character: its anchor (width, hash, place in the segment), and a hash of the whole segment.

    How many windows of the list share a hash is counted in 2^SKETCH_BITS slots. The terms
    are read twice and not shuffled but for making them distinct.
    """

    def parted(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """Terms with a literal character, their segments, and regular expressions of those with wildcards; some at a time."""
        terms = batch["match_term"].cast(pa.string())
        wild = pc.match_substring_regex(terms, "[%_]") if wildcards else pa.repeat(False, len(terms))
        plain, rows = terms.filter(pc.invert(wild)), []
        for term in terms.filter(wild).to_pylist():
            if parts := segments(term):
                rows.append((term, max((p.encode() for p in parts), key=len), like_regex(term) if parts != [term.strip("%")] else None))
        own, segment, pattern = (pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.string())))
        own, segment = pa.concat_arrays([plain, own]), pa.concat_arrays([plain.cast(pa.binary()), segment])
        pattern = pa.concat_arrays([pa.nulls(len(plain), pa.string()), pattern])
        upto, a = np.cumsum(pc.binary_length(segment).to_numpy(zero_copy_only=False)), 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BLOCK, "right")))
            yield own[a:b], segment[a:b], pattern[a:b]
            a = b

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, own, _ in parted(batch):
                _, _, places, hashes = _spread_windows(own)
                found.append(hashes[np.diff(places, axis=1, prepend=-1) > 0])
            slots, n = np.unique(np.concatenate([np.empty(0, "uint64"), *found]) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
            yield _batch([slots.astype("int64"), n], "slot long, n long")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, segment, pattern in parted(batch):
                size, width, places, hashes = _spread_windows(segment)
                best = POSITIONS - 1 - np.argmin(shared[hashes >> np.uint64(64 - SKETCH_BITS)][:, ::-1], axis=1)
                each = np.arange(len(own))
                ends = both_ends(hashes[:, 0], hashes[:, -1], size).view("int64")
                yield _batch([own, segment, pattern, width, places[each, best], hashes[each, best].view("int64"), ends], _WINDOWS)

    distinct = terms.select("match_term").filter("match_term <> ''").distinct()
    counted = distinct.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    shared = np.zeros(1 << SKETCH_BITS, "int64")
    shared[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    return distinct.mapInArrow(choose, _WINDOWS)


def _spread_windows(segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of segments and widths of their windows; places and hashes of POSITIONS windows of each, places repeat in short ones."""
    offsets = np.frombuffer(segments.buffers()[1], "int32")[segments.offset : segments.offset + len(segments) + 1].astype("int64")
    data = np.frombuffer(segments.buffers()[2], "uint8")[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    sizes, code = np.unique(size, return_inverse=True)
    width = np.array([widest(n) for n in sizes.tolist()])[code]
    places = np.arange(POSITIONS) * (size - width)[:, None] // (POSITIONS - 1)
    at = (offsets[:-1] - offsets[0])[:, None] + places
    hashes = np.empty(at.shape, "uint64")
    for w, windows in window_hashes(data, np.unique(width).tolist()):
        hashes[width == w] = windows[at[width == w]]
    return size, width, places, hashes


def both_ends(first: np.ndarray, last: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Hashes of segments, from those of their first and last windows."""
    return mixed(first * np.uint64(_SIZED) + last + np.asarray(size, "uint64"))


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}
    columns = [c if isinstance(c, pa.Array) else pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, schema.split(", "), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


class BitMap:
    """A few bits for each of a set of 64-bit hashes.

    Its pieces are made on the executors. The driver gets them as bytes, 2^MOST_BITS / 8 of them at
    most whatever the set's size, hands them to the tasks as a broadcast variable and keeps no copy.
    """

    def __init__(self, hashes: DataFrame, n: int):
        self.shared = None
        if not n:
            return
        self.bits = min(MOST_BITS, max(10, (BITS_EACH * n).bit_length()))
        passed = [(1 - math.exp(-k * n / (1 << self.bits))) ** k for k in range(1, len(_PROBES) + 1)]
        self.probes = 1 + next((k for k, share in enumerate(passed) if share <= FALSE), passed.index(min(passed)))
        own = min(PIECE_BITS, self.bits)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch["hash"].to_numpy().view("uint64")
                places = np.unique(np.concatenate([self._place(values, k) for k in range(self.probes)]))
                first = np.flatnonzero(np.diff(places >> own, prepend=-1))
                inside = np.split((places & (1 << own) - 1).astype("uint32"), first[1:])
                yield _batch([places[first] >> own, [x.tobytes() for x in inside] if len(first) else []], "piece int, places binary")

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, np.ndarray] = {}
            for batch in batches:
                for piece, places in zip(batch["piece"].to_pylist(), batch["places"], strict=True):
                    places = np.frombuffer(places.as_buffer(), "uint32")
                    at = places >> np.uint32(6)
                    first = np.flatnonzero(np.diff(at, prepend=~at[:1]))
                    words = made.setdefault(piece, np.zeros(1 << own - 6, "uint64"))
                    words[at[first]] |= np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint32(63)).astype("uint64"), first)
            for piece, words in made.items():
                yield _batch([[piece], [words.tobytes()]], "piece int, words binary")

        pieces = hashes.select("hash").mapInArrow(spread, "piece int, places binary").repartition("piece")
        found = pieces.mapInArrow(gather, "piece int, words binary").toArrow()
        words = np.zeros((1 << self.bits - own, 1 << own - 6), "uint64")
        for piece, part in zip(found["piece"].to_pylist(), found["words"], strict=True):
            words[piece] = np.frombuffer(part.as_buffer(), "uint64")
        self.shared = hashes.sparkSession.sparkContext.broadcast(words.reshape(-1))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where a hash may be in the set."""
        if self.shared is None:
            return np.empty(0, "int64")
        words = self.shared.value
        at = np.flatnonzero(self._bit(words, self._place(hashes, 0)))
        for k in range(1, self.probes):
            at = at[self._bit(words, self._place(hashes[at], k))]
        return at

    def _place(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Where the bit of number k of each hash is."""
        return ((hashes * np.uint64(_PROBES[k]) if k else hashes) >> np.uint64(64 - self.bits)).view("int64")

    @staticmethod
    def _bit(words: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (words[place >> 6] >> (place & 63).view("uint64") & np.uint64(1)).astype("bool")


def _around(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The bytes from `low` to `high`, for each pair."""
    n = high - low
    upto = np.concatenate([[0], np.cumsum(n)])
    index = np.repeat(low - upto[:-1], n) + np.arange(upto[-1])
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(upto.astype("int32")), pa.py_buffer(data[index])])


def contained(
    rows: DataFrame, columns: Sequence[str], keep: Sequence[str], anchors: DataFrame, proper: bool = False, any_term: Staging | None = None
) -> DataFrame:
    """Columns `keep` of rows that contain a term in one of `columns`, with `match_term` and a row's number `_row`.

    A row is given for each term that it contains, more than once where the term lies several times.
    Numbers are given in the scan and go with the rows, so that no second scan has to repeat them.
    `proper`: a text that is a term itself need not be given for that term.
    `any_term`: one of the terms will do, so that the others need not be tested; what the scan
    finds is written there once. Then the result has no `match_term`.
    """
    shape = "width", F.isnull("pattern").alias("literal"), "place", F.octet_length("segment").alias("size")
    found_shapes = anchors.groupBy(*shape).count().collect()
    widths = sorted({r.width for r in found_shapes})
    literal, patterns = (_Kind(anchors.filter(F.isnull("pattern") == F.lit(kind)), [r for r in found_shapes if r.literal == kind]) for kind in (True, False))
    found = _scanned(rows, columns, keep, literal, patterns, widths, proper)
    given = [*keep, "_row"] if any_term else [*keep, "_row", "match_term"]
    if all(r.literal for r in found_shapes):
        return _literals(found, anchors).select(*given)
    if any_term:
        return _settled(any_term.write(found), anchors, given, any_term)
    held, pairs = _literals(found, anchors).select(*given), _pairs(found, anchors)
    texts = found.filter("whole IS NOT NULL").select(*keep, "_row", "whole")
    return held.unionByName(texts.join(pairs, "_row").filter("whole rlike pattern").select(*keep, "_row", "match_term"))


def _settled(found: DataFrame, anchors: DataFrame, given: Sequence[str], staging: Staging) -> DataFrame:
    """Columns `given` of the rows that contain a term: literals first, patterns are sought in what is left.

    Only texts with a pair leave for the shuffle, and few others: a bit map of their numbers comes before it.
    """
    held = staging.write(_literals(found, anchors).select(*given).dropDuplicates(["_row"]))
    settled = held.select(F.col("_row").alias("_of"))
    pairs = staging.write(_pairs(found.join(settled, F.expr("_row = _of"), "left_anti"), anchors).select(F.col("_row").alias("_of"), "pattern"))
    numbers = pairs.select("_of").distinct().select(F.xxhash64("_of").alias("hash"))
    wanted = BitMap(numbers, numbers.count())

    def perhaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(wanted.places(batch["hash"].to_numpy().view("uint64"))))

    texts = found.filter("whole IS NOT NULL").select(*given, "whole", F.xxhash64("_row").alias("hash"))
    texts = texts.mapInArrow(perhaps, texts.schema)
    return held.unionByName(texts.join(pairs, F.expr("_row = _of AND whole rlike pattern"), "left_semi").select(*given))


def _literals(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """The candidates of literals that hold them."""
    held = "at >= place AND substring(around, at - place + 1, octet_length(segment)) = segment"
    return found.filter("whole IS NULL").join(anchors.filter("pattern IS NULL"), ["width", "hash"]).filter(held)


def _pairs(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """Numbers of rows with patterns that they may fit; no text travels with a pair."""
    near = found.filter("whole IS NOT NULL").select("_row", F.explode("near").alias("hash"))
    return near.join(anchors.filter("pattern IS NOT NULL").select("hash", "match_term", "pattern"), "hash").drop("hash")


def _scanned(
    rows: DataFrame, columns: Sequence[str], keep: Sequence[str], literal: _Kind, patterns: _Kind, widths: list[int], proper: bool
) -> DataFrame:
    """A row per candidate of a literal (width, hash, at, around), and one per text with candidates of patterns (near, whole)."""
    given = rows.select(*keep, *(F.col(c).alias(f"_searched_{i}") for i, c in enumerate(columns)))
    kept = given.select(*keep).schema
    schema = StructType(kept.fields).add("_row", "long").add("width", "integer").add("hash", "long").add("at", "integer").add("around", "binary").add("near", ArrayType(LongType())).add("whole", "string")
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(len(columns)):
                data, offsets = lower_bytes(batch[f"_searched_{i}"])
                for text, *found in _candidates(data, offsets, widths, literal, patterns, proper):
                    own = [batch[c].take(text) for c in keep]
                    n = pa.array(number + text.to_numpy(), "int64")
                    found = [pa.nulls(len(text), kind) if f is None else f.cast(kind) for f, kind in zip(found, arrow.types[-6:], strict=True)]
                    yield pa.RecordBatch.from_arrays([*own, n, *found], schema=arrow)
            number += batch.num_rows

    return given.mapInArrow(scan, schema)


class _Kind:
    """The maps of literals or of patterns: their anchors, and whole segments of widths with few shapes."""

    def __init__(self, anchors: DataFrame, shapes: list[Row]):
        self.anchors = BitMap(anchors.select("hash"), sum(r["count"] for r in shapes))
        self.widths = {r.width for r in shapes}
        few: dict[int, list[tuple[int, int]]] = {}
        for r in shapes:
            few.setdefault(r.width, []).append((r.place, r.size))
        self.shapes = {width: sorted(own) for width, own in few.items() if len(own) <= MOST_SHAPES}
        n = sum(r["count"] for r in shapes if r.width in self.shapes)
        self.whole = BitMap(anchors.filter(F.col("width").isin(list(self.shapes))).select(F.col("ends").alias("hash")), n)

    def whole_terms(self, hashes: np.ndarray, width: int, at: np.ndarray, begin: np.ndarray, end: np.ndarray, proper: bool) -> np.ndarray:
        """Which of the windows `at` may lie in a whole segment within `begin` and `end`; hashes: of all windows."""
        passed = np.zeros(len(at), "bool")
        place, size = np.array(self.shapes[width], "int64").T
        step = max(1, BLOCK // len(place))  # windows tested with all shapes at a time
        for a in range(0, len(at), step):
            low, high = begin[a : a + step, None], end[a : a + step, None]
            start = at[a : a + step, None] - place
            fits = (start >= low) & (start + size <= high)
            if proper:
                fits &= size < high - low
            window, shape = np.nonzero(fits)
            start = start[fits]
            ends = both_ends(hashes[start], hashes[start + size[shape] - width], size[shape])
            passed[a + window[self.whole.places(ends)]] = True
        return passed


def _candidates(data: np.ndarray, offsets: np.ndarray, widths: list[int], literal: _Kind, patterns: _Kind, proper: bool) -> Iterator[tuple]:
    """For literals text, width, hash, place in the bytes around, those bytes; for patterns text, hashes, the text itself."""
    begin, end = offsets[:-1], offsets[1:]
    last = int(offsets[-1])
    margin = max([0, *literal.shapes, *patterns.shapes])  # a whole term may begin and end so much before and after
    near = [np.empty((2, 0), "int64")]
    for low in range(0, last, BLOCK):
        base = max(0, low - margin)
        for width, windows in window_hashes(data[base : min(low + BLOCK + widths[-1] + margin, last)], widths):
            hashes = windows[low - base : low - base + BLOCK]
            for kind, whole in ((literal, False), (patterns, True)):
                if width not in kind.widths:
                    continue
                at = kind.anchors.places(hashes)
                value, at = hashes[at].view("int64"), at + low
                text = np.searchsorted(end, at, "right")
                inside = at + width <= end[text]
                if width in kind.shapes:
                    some = np.flatnonzero(inside)
                    own = text[some]
                    inside[some] = kind.whole_terms(windows, width, at[some] - base, begin[own] - base, end[own] - base, proper and not whole)
                value, at, text = value[inside], at[inside], text[inside]
                if whole:  # the text decides, wherever in it the window lies
                    once = _first_of_each(value, text)
                    near.append(np.stack([text[once], value[once]]))
                    continue
                for a in range(0, len(at), BATCH_ROWS):
                    v, p, t = (x[a : a + BATCH_ROWS] for x in (value, at, text))
                    first = np.maximum(begin[t], p - width)
                    around = _around(data, first, np.minimum(end[t], p + 2 * width))
                    once = _first_of_each(t, v, p - first, around.dictionary_encode().indices.to_numpy())
                    columns = (pa.array(v), pa.array(p - first, pa.int32()), around)
                    yield pa.array(t[once]), pa.array(np.full(len(once), width)), *(c.take(pa.array(once)) for c in columns), None, None
    text, value = np.unique(np.concatenate(near, axis=1), axis=1)
    first = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(text))
    texts = text[first[:-1]]
    upto, a = np.cumsum(end[texts] - begin[texts]), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + WHOLE_BYTES, "right")))
        t = texts[a:b]
        hashes = pa.ListArray.from_arrays(pa.array(first[a : b + 1] - first[a], pa.int32()), pa.array(value[first[a] : first[b]]))
        yield pa.array(t), None, None, None, None, hashes, _around(data, begin[t], end[t]).cast(pa.string())
        a = b


def _first_of_each(*columns: np.ndarray) -> np.ndarray:
    """Where distinct combinations stand first."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), "bool")
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return np.sort(order[new])


def keep_containing(rows: DataFrame, columns: Sequence[str], keep: Sequence[str], terms: DataFrame, wildcards: bool, staging: Staging) -> DataFrame:
    """Columns `keep` of the rows that contain a term, each row once.

    Terms are in lower case, texts are compared in lower case. The terms may have any size; rows come from a
    scan that gives them in the same order again if a task is repeated.
    """
    hits = []
    # An empty term or a pattern of wildcards alone holds wherever a text has so many characters.
    bare = terms.filter("translate(match_term, '%_', '') = ''" if wildcards else "match_term = ''")
    least = bare.agg(F.min(F.length(F.regexp_replace("match_term", "%", "")))).first()[0]
    if least is not None:
        long = F.coalesce(F.greatest(*[F.char_length(F.lower(c)) for c in (*columns, columns[0])]), F.lit(-1)) >= least
        hits.append(rows.filter(long).select(*keep))
        rows = rows.filter(~long)
    if not terms.filter(r"match_term rlike '[^\x00-\x7F]'").isEmpty():
        # Only the JVM's lower case counts for characters beyond ASCII.
        lowered = {f"_lower_{i}": F.lower(c) for i, c in enumerate(columns)}
        rows, columns = rows.withColumns(lowered), list(lowered)
    anchors = staging.write(anchors_of(terms, wildcards))
    if anchors.isEmpty():
        return hits[0] if hits else rows.filter("false").select(*keep)
    found = contained(rows, columns, keep, anchors, any_term=staging)
    first = F.first(F.struct(*keep)).alias("kept")
    hits.append(found.groupBy("_row").agg(first).select("kept.*"))
    return hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
