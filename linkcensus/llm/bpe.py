"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

Each match of the splitting pattern is encoded separately. A task gathers the distinct
matches of a chunk of its texts; those that are tokens themselves need no merge. The
others become token-position rows in DuckDB, one token per byte at first. A recursive query
joins neighbouring tokens to the merge table (two ids whose bytes together are a token),
contracts the leftmost pair of least rank in each piece, and goes on with the pieces that had
one, until none has. Decoding joins token-position rows to the vocabulary and puts the bytes of
each piece together by an ordered aggregation.

The rows a recursion holds grow with the square of a piece's length, so pieces over
LONGEST bytes (a run of letters of that length without a break) are merged instead with a
heap over a linked list, which takes n log n steps and gives the same tokens.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcensus.llm.common import coded_words, text_chunks

LONGEST = 128
RECURSION_ROWS = 2_000_000  # the squares of the lengths of the pieces of one recursion add up to this
DECODED_IDS = 500_000  # ids that one query decodes
CHUNK_BYTES = 4 << 20
MEMORY = "250MB"
KNOWN_PIECES = 150_000  # of either generation of the cache
# a blank next to white space
_WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_DOUBTFUL = f" {_WHITE}|{_WHITE} "

# here: rank of the pair that a token starts, times 1024, plus its position; null if it is no token
_MERGE = """
WITH RECURSIVE state(step, piece, pos, id, next_pos, next_id, here) AS (
    SELECT 0, piece, pos, id, next_pos, next_id, merged::BIGINT * 1024 + pos
    FROM start LEFT JOIN merges ON first = id AND second = next_id
    UNION ALL
    SELECT step, piece, pos, id, next_pos, next_id,
           CASE WHEN touched THEN merged::BIGINT * 1024 + pos ELSE here END
    FROM (
        SELECT s.step + 1 AS step, s.piece, s.pos, s.here,
               CASE WHEN s.here = c.best THEN c.merges_to ELSE s.id END AS id,
               CASE WHEN s.here = c.best THEN c.next_pos ELSE s.next_pos END AS next_pos,
               CASE WHEN s.here = c.best THEN c.next_id WHEN s.next_pos = c.at THEN c.merges_to ELSE s.next_id END AS next_id,
               coalesce(s.here = c.best, false) OR s.next_pos = c.at AS touched
        FROM state s JOIN (
            SELECT b.piece, b.best, b.best >> 10 AS merges_to, b.best & 1023 AS at, b.gone, d.next_pos, d.next_id
            FROM (SELECT piece, min(here) AS best, arg_min(next_pos, here) AS gone FROM state GROUP BY piece) b
            JOIN state d ON d.piece = b.piece AND d.pos = b.gone
        ) c ON c.piece = s.piece AND c.gone <> s.pos
    ) LEFT JOIN merges m ON m.first = CASE WHEN touched THEN id END AND m.second = next_id
), last AS (SELECT piece, max(step) AS step FROM state GROUP BY piece)
SELECT piece, pos, id FROM state JOIN last USING (piece, step) ORDER BY piece, pos
"""

_DECODE = """
SELECT t.piece, string_agg(v.hex, '' ORDER BY t.pos) AS hex FROM tokens t JOIN vocabulary v USING (id) GROUP BY t.piece
"""


class Codec:
    """Ranks, merge table and a DuckDB connection of one task; a worker keeps none of it for later tasks."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        ranks = self.ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        pairs = (
            (ranks[a], ranks[b], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (a := token[:i]) in ranks and (b := token[i:]) in ranks
        )
        merges = np.fromiter(itertools.chain.from_iterable(pairs), "int32").reshape(-1, 3)
        self._table("merges", merges, ["first", "second", "merged"])
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), "int32"), "hex": [t.hex() for t in ranks]})
        self.db.register("given", vocabulary)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")

    def _table(self, name: str, rows: np.ndarray, columns: list[str]) -> None:
        self.db.register("given", pa.table({c: np.ascontiguousarray(rows[:, i]) for i, c in enumerate(columns)}))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of the distinct pieces, as the bytes of 32-bit integers."""
        data = [p.encode() for p in pieces]
        out = [b""] * len(data)
        rows = []
        for i, piece in enumerate(data):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = _packed([rank])
            elif len(piece) > LONGEST:
                out[i] = _packed(self._long(piece))
            else:
                rows.append(i)
        upto = np.cumsum([len(data[i]) ** 2 for i in rows])
        at = 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + RECURSION_ROWS, "right")))
            self._contract(data, rows[at:stop], out)
            at = stop
        return out

    def _contract(self, data: list[bytes], rows: list[int], out: list[bytes]) -> None:
        size = np.array([len(data[i]) for i in rows])
        first = np.array([self.ranks[bytes([b])] for b in range(256)], dtype="int32")
        start = np.full((size.sum(), 5), -1, "int32")
        start[:, 0] = np.repeat(rows, size)
        start[:, 1] = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start[:, 2] = first[np.frombuffer(b"".join(data[i] for i in rows), "uint8")]
        start[:-1, 3:] = start[1:, 1:3]
        start[np.cumsum(size) - 1, 3:] = -1  # a piece's last token has no next one
        self._table("start", start, ["piece", "pos", "id", "next_pos", "next_id"])
        found = self.db.execute(_MERGE).fetchnumpy()
        piece, ids = found["piece"], found["id"].astype("int32").tobytes()
        begin = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        ends = (4 * np.append(begin[1:], len(piece))).tolist()
        for i, a, b in zip(piece[begin].tolist(), (4 * begin).tolist(), ends, strict=True):
            out[i] = ids[a:b]

    def _long(self, piece: bytes) -> list[int]:
        """The same contraction for one long piece: a heap of (rank, position) over a linked list."""
        ids = [self.ranks[bytes([b])] for b in piece]

        def merge(a: int, b: int) -> int | None:
            return self.ranks.get(self.tokens[a] + self.tokens[b])

        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := merge(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        gone = [False] * len(ids)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = rank, True, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (r := merge(ids[x], ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x, dead in zip(ids, gone, strict=True) if not dead]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of ids of each text; no text is null.

        Texts are taken as stretches that start at single blanks: a blank between two other
        characters that are not white space always starts a match, and no match reaches over
        it. A text with a blank next to other white space is one stretch as a whole.
        """
        odd = pc.match_substring_regex(texts, _DOUBTFUL).to_numpy(zero_copy_only=False)
        code, words, counts = coded_words(pc.if_else(pa.array(odd, "bool"), "", texts))
        start = np.cumsum(counts) - counts
        heads, head = np.unique(code[start], return_inverse=True)
        stretches = [" " + w for w in words] + [words[i] for i in heads]
        code = code.astype("int64")
        code[start] = len(words) + head
        code[start[odd]] = len(stretches) + np.arange(odd.sum())
        stretches += texts.filter(pa.array(odd, "bool")).to_pylist()
        used = np.zeros(len(stretches), "bool")
        used[code] = True
        matches = [self.pattern.findall(s) if u else [] for s, u in zip(stretches, used.tolist(), strict=True)]
        found = self._known(set(itertools.chain.from_iterable(matches)))
        own = [found[m[0]] if len(m) == 1 else b"".join([found[p] for p in m]) for m in matches]
        size = np.array([len(x) for x in own], dtype="int64") // 4
        flat = np.frombuffer(b"".join(own), "int32")
        n = size[code]
        ids = flat[np.repeat((np.cumsum(size) - size)[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return ids, np.add.reduceat(n, start) if len(texts) else n

    def _known(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of the pieces. Pieces of the chunks before are remembered, in two generations:

        a full one takes the place of the older, and what is used again moves to the younger.
        """
        found = {p: ids for p in pieces if (ids := self.known.get(p) or self.known_before.get(p)) is not None}
        new = list(pieces - found.keys())
        found.update(zip(new, self.encode_pieces(new), strict=True))
        if len(self.known) > KNOWN_PIECES:
            self.known, self.known_before = {}, self.known
        self.known.update(found)
        return found

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text from all ids in a row; a text without ids is empty."""
        out = [b""] * len(counts)
        text = np.repeat(np.arange(len(counts), dtype="int32"), counts)
        for at in range(0, len(ids), DECODED_IDS):
            part = slice(at, at + DECODED_IDS)
            tokens = np.stack([text[part], np.arange(len(ids[part]), dtype="int32"), ids[part]], axis=1)
            self._table("tokens", tokens, ["piece", "pos", "id"])
            found = self.db.execute(_DECODE).fetchnumpy()
            for i, own in zip(found["piece"].tolist(), found["hex"].tolist(), strict=True):
                out[i] += bytes.fromhex(own)
        return out


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="int32").tobytes()


def with_tokens(docs: DataFrame, rank_file: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of docs (doc_id, text), and with `decoded` also the bytes decoded from the ids.

    As the tiktoken library's encode_ordinary. Null and empty texts have no ids. Repeated
    rows are encoded one by one; other columns are left out. A single text is never split, whatever its length.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(rank_file, pattern)
        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            for a, b in text_chunks(texts, CHUNK_BYTES):
                ids, counts = codec.encode(texts[a:b])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype("int32")
                columns = {"doc_id": batch["doc_id"][a:b], "ids": pa.ListArray.from_arrays(ends, ids)}
                if decoded:
                    columns["decoded"] = pa.array(codec.decode(ids, counts), "binary")
                yield pa.RecordBatch.from_pydict(columns)
                pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(encoded, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode_documents(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) of tokens (doc_id, ids array<int>). Null or empty ids give empty bytes."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(rank_file, pattern)
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch["ids"]), 0).to_numpy(zero_copy_only=False)
            ids = pc.list_flatten(batch["ids"]).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "decoded": pa.array(codec.decode(ids, counts), "binary")})

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decoded, "doc_id long, decoded binary")


def digests(tokens: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of tokens (doc_id, ids, decoded), and the columns named."""
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
