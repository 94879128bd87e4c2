"""Token sequences of a fixed window, filled by bounded-space online packing.

Every task encodes its documents and keeps a fixed number of open windows. What a document
has beyond whole windows goes to the open window that it fits best (the least room that is
enough). Where none fits and all are open, the fullest one is filled up with the beginning of
the piece and emitted, and the rest of the piece is placed anew. So a window is emitted full, a
document is cut only then, and a task's memory does not grow with its input.

The windows that tasks leave open are written with their ids, small beside the data: at most
`open_windows` of them for a task. Rounds of the same packing over fewer and fewer tasks merge
them; the last task fills whole windows from what is left and cuts the rest at powers of
two, which need no padding.

A sequence's id names the round, the task and the number in the task that made it.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkcensus.llm.common import stored, text_chunks

WINDOW = 1024
OPEN_WINDOWS = 32
END_ID = 0
CHUNK_BYTES = 4 << 20
#: A round of merging gives each task what this many tasks may have left.
MERGED_TASKS = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]

# The pattern of the byte-level splitting step, and characters that all libraries class alike.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_SETTLED = "\\x00-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u1e00-\u1e99\u2010-\u2027\u2030-\u205e\u3041-\u3094\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3"
_ENCODERS: dict[str, TextEncoder] = {}


class TextEncoder:
    """Ids of whole texts, as the tokenizers library gives them.

    If the file is a byte-level BPE whose ids follow the order of its merges, the same merges run in
    tiktoken, at a quarter of the time. Texts that may hold a special token, or characters
    that the libraries' Unicode versions might class differently, go through the tokenizer itself,
    as do all texts with any other kind of tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        whole = json.loads(self.tokenizer.to_str())
        model, step, added = whole["model"], whole["pre_tokenizer"] or {}, whole["added_tokens"]
        vocabulary = dict(model.get("vocab", {})) if model["type"] == "BPE" else {}
        for token in added:
            vocabulary.pop(token["content"], None)
        merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model.get("merges", [])]
        self.fast = None
        if (
            merged
            and None not in merged
            and merged == sorted(merged)
            and len(merged) + 256 == len(vocabulary)
            and (step.get("type"), step.get("add_prefix_space"), step.get("use_regex")) == ("ByteLevel", False, True)
            and not whole["normalizer"]
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        ):
            # the byte-level alphabet: bytes that print stand for themselves, the others for 256 and up
            prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            letters = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(prints)))}
            ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
            self.fast = tiktoken.Encoding("packing", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.doubtful = "|".join([f"[^{_LONG_SETTLED}]", *(re.escape(t["content"]) for t in added)])

    @classmethod
    def cached(cls, path: str) -> TextEncoder:
        """One per worker process."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; none is null."""
        slow = [True] * len(texts) if self.fast is None else pc.match_substring_regex(texts, self.doubtful).to_pylist()
        return [
            np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4") if odd else self.fast.encode_to_numpy(text, disallowed_special=())
            for text, odd in zip(texts.to_pylist(), slow, strict=True)
        ]


@dataclass
class Piece:
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:n]),
            Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[n:]),
        )


class Packer:
    """The open windows of one task, and the rows that are ready."""

    def __init__(self, window: int, open_windows: int, first_sequence: int, with_ids: bool):
        self.window, self.most, self.sequence, self.with_ids = window, open_windows, first_sequence, with_ids
        self.room: list[tuple[int, int]] = []  # of each open window, with its number; sorted
        self.open: dict[int, list[Piece]] = {}
        self.numbers = itertools.count()
        self.rows: list[tuple] = []

    def add(self, piece: Piece) -> None:
        while len(piece.ids) >= self.window:
            whole, piece = piece.cut(self.window)
            self._emit([whole])
        while len(piece.ids):
            at = bisect.bisect_left(self.room, (len(piece.ids), -1))
            if at == len(self.room) and len(self.room) == self.most:
                at, (room, _) = 0, self.room[0]  # none fits: the fullest takes what it can, and goes
                part, piece = piece.cut(room)
            else:
                if at == len(self.room):
                    number = next(self.numbers)
                    self.open[number] = []
                    self.room.append((self.window, number))
                part, piece = piece, piece.cut(len(piece.ids))[1]
            room, number = self.room.pop(at)
            self.open[number].append(part)
            if room > len(part.ids):
                bisect.insort(self.room, (room - len(part.ids), number))
            else:
                self._emit(self.open.pop(number))

    def _emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self._row(p, self.sequence, offset, self.with_ids)
            offset += len(p.ids)
        self.sequence += 1

    def _row(self, p: Piece, sequence: int | None, offset: int | None, with_ids: bool) -> None:
        data = p.ids.tobytes()
        self.rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(data), p.doc_tokens, sequence, offset, data if with_ids else None))

    def leave(self) -> None:
        """Rows, with ids and without a sequence, for what is in the open windows."""
        for _, number in self.room:
            for p in self.open[number]:
                self._row(p, None, None, True)
        self.room, self.open = [], {}

    def finish(self) -> None:
        """Whole windows from all that is left, the fullest window first; the rest in powers of two."""
        pieces = [p for _, number in self.room for p in self.open[number]]
        self.room, self.open = [], {}
        left = sum(len(p.ids) for p in pieces)
        while left:
            size = self.window if left >= self.window else 1 << left.bit_length() - 1
            left -= size
            group = []
            while size:
                part, rest = pieces[0].cut(size)
                pieces[:1] = [rest] if len(rest.ids) else []
                group.append(part)
                size -= len(part.ids)
            self._emit(group)

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [list(c) for c in zip(*self.rows, strict=True)]
            types = [pa.binary() if name == "ids" else pa.int64() for name in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)
            self.rows = []


def packed(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of `docs` (doc_id long, text) in sequences of at most `window` ids (a power of two).

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens
    (of the document, its end id included), sequence_id, offset (of the piece in it) and ids
    (little-endian unsigned 32-bit; null unless `with_ids`).

    Null and empty texts are the end id alone. Repeated rows and null ids are packed like any
    other. Other columns are left out. An empty table gives no rows.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")

    def encode_and_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, end = TextEncoder.cached(tokenizer_path), _packer(0), np.array([end_id], "<u4")
        for batch in batches:
            texts, names = pc.fill_null(batch["text"], ""), batch["doc_id"].to_pylist()
            for a, b in text_chunks(texts, CHUNK_BYTES):
                for name, ids in zip(names[a:b], encoder.encode(texts[a:b]), strict=True):
                    packer.add(Piece(name, 0, len(ids) + 1, np.concatenate([ids, end])))
                _keep_small(packer)
                yield from packer.taken()
                pa.default_memory_pool().release_unused()
        packer.leave()
        yield from packer.taken()

    def _packer(round_: int) -> Packer:
        task = TaskContext.get().partitionId()
        return Packer(window, open_windows, (round_ << 24 | task) << 32, with_ids)

    def merging(round_: int, last: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = _packer(round_)
            for batch in batches:
                for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                    packer.add(Piece(*row[:3], np.frombuffer(row[3], "<u4")))
                yield from packer.taken()
            packer.finish() if last else packer.leave()
            yield from packer.taken()

        return merge

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = stored(rows.mapInArrow(encode_and_pack, PIECES), "packing")
    ready, round_ = [made.filter("sequence_id IS NOT NULL")], 0
    while left := made.filter("sequence_id IS NULL").agg(F.sum("length")).first()[0]:
        round_ += 1
        tasks = -(-left // (MERGED_TASKS * open_windows * window))
        rest = made.filter("sequence_id IS NULL").coalesce(tasks)
        made = stored(rest.mapInArrow(merging(round_, tasks == 1), PIECES), "packing-merge")
        ready.append(made.filter("sequence_id IS NOT NULL"))
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out


def _keep_small(packer: Packer) -> None:
    """Open pieces stop referring to the ids of a whole chunk."""
    for pieces in packer.open.values():
        for p in pieces:
            if p.ids.base is not None:
                p.ids = p.ids.copy()


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, length, ids array<long>) of pieces with ids; padded to `window` unless the length is a power of two."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, padded = [], []
            for parts in batch["parts"].to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype("int64")
                lengths.append(len(ids))
                full = len(ids) if not len(ids) & (len(ids) - 1) else window
                padded.append(np.pad(ids, (0, full - len(ids)), constant_values=pad_id))
            yield pa.RecordBatch.from_pydict({"sequence_id": batch["sequence_id"], "length": pa.array(lengths, "int64"), "ids": pa.array(padded, pa.list_(pa.int64()))})

    groups = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return groups.mapInArrow(joined, "sequence_id long, length long, ids array<long>")
