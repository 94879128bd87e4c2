"""Token-id files compressed by a grammar (Re-Pair), with random access to documents.

Rows are range-partitioned by document id. Each shard's ids are encoded there and then
reduced: frequent neighbouring pairs of ids become new ids (nonterminals), round after
round, until no pair is frequent or the 16-bit ids are used up. A pair never reaches
over a document's end, so that any document can be decoded alone: the file holds the
rules, how many ids each symbol stands for, and where each document starts, both in
symbols and in ids.

One round replaces many pairs at once: where two chosen pairs overlap, the one further
left wins. Files are written under a name of their own and renamed when whole; a row per
file, returned by the task that wrote it, says which files count. A task that is
repeated writes another file, and only one of the two is listed.

File format, little-endian: MAGIC; five uint64 (base, documents, rules, symbols, ids);
document ids int64; first symbol of each document and the end, uint64; first id of each
document and the end, uint64; ids per rule uint32; rules as two uint16 each; symbols uint16. Ids from `base` on are rules: `base + r` is rule r.
"""

from __future__ import annotations

import itertools
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkcensus.llm.common import coded_pieces, shared_folder, text_chunks

MAGIC = b"LCREPAI2"
END_ID = 1
SHARD_BYTES = 12 << 20  # of text, before encoding
PAIRS_A_ROUND = 4096
LEAST_COUNT = 24
KNOWN_PIECES = 200_000
BLOCK_IDS = 200_000
_STOPS, _PLAIN = ".,;:!?", "\u0130"
_LETTERS = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+$"  # all letters below _PLAIN
_END = "\x01"
_SLOTS = 18
_HASH = np.uint32(0x9E3779B1)
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts with a tokenizer that never joins characters over a blank, each distinct word once.

    Of words in Latin letters, which lower-case and compose alike one by one, each match of
    the tokenizer's own splitting pattern goes to its model; other words, and any that may
    hold a special token, go through the whole tokenizer. Words of plain letters alone go
    all at once through the same merges in tiktoken, if the model's ids follow their order.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        whole = json.loads(self.tokenizer.to_str())
        steps = whole["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
        # the byte-level alphabet: bytes that print stand for themselves, the others for 256 and up
        prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = [b for b in range(256) if b not in prints]
        self.alphabet = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.fast, self.ends = self._merges(whole["model"], [t["content"] for t in whole["added_tokens"]])
        self.known: dict[str, list[int]] = {}
        self.known_before: dict[str, list[int]] = {}

    @classmethod
    def cached(cls, path: str) -> WordEncoder:
        """One per worker process."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _merges(self, model: dict, added: list[str]) -> tuple[tiktoken.Encoding | None, np.ndarray]:
        """The model's merges for words that _END follows, and which ids end a word; none if ids do not follow the merges' order.

        A word's last letter and its end are one symbol from the outset: their merge ranks before all others.
        """
        none = None, np.empty(0, "bool")
        suffix = model.get("end_of_word_suffix")
        if not suffix or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")):
            return none
        vocabulary = {token: i for token, i in model["vocab"].items() if token not in added}
        merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
        singles = [vocabulary.get(c + end) for c in self.alphabet.values() for end in ("", suffix)]
        if not merged or None in merged + singles or merged != sorted(merged) or max(singles) > merged[0] or len(merged) + 512 != len(vocabulary):
            return none
        letters = {c: b for b, c in self.alphabet.items()}
        ranks, ends = {_END.encode(): max(vocabulary.values()) + 1}, np.zeros(max(vocabulary.values()) + 2, "bool")
        for token, i in vocabulary.items():
            ends[i] = token.endswith(suffix)
            own = bytes(letters[c] for c in token.removesuffix(suffix))
            if _END.encode() not in own:  # no word of letters holds it
                ranks[own + _END.encode() if ends[i] else own] = i
        return tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={}), ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text, the end id included. Null: empty."""
        code, distinct, counts = coded_pieces(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "))
        size, flat = self._coded(distinct)
        first = np.cumsum(size) - size
        n = size[code]
        ids = flat[np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        upto = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        return np.insert(ids, upto, END_ID), np.diff(upto, prepend=0) + 1

    def _coded(self, given: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the words has, and all their ids.

        Words of plain letters with one stop after them, or none, are taken apart as arrays, so that
        only distinct words in lower case are looked up; the rest one by one.
        """
        core = pc.utf8_rtrim(given, _STOPS)
        stops = (pc.binary_length(given).to_numpy() - pc.binary_length(core).to_numpy()).astype("int64")
        plain = pc.match_substring_regex(core, _LETTERS).to_numpy(zero_copy_only=False) & (stops <= 1)
        coded = pc.utf8_lower(core.filter(pa.array(plain))).dictionary_encode()
        heads = coded.dictionary
        rest = np.flatnonzero(~plain)
        others = [self._piece(s) for s in _STOPS] + self._words(given.take(pa.array(rest)).to_pylist()) + [[]]
        size, flat = (np.concatenate(x) for x in zip(self._letters(heads), _flat(others), strict=True))
        # two parts for each word: itself or its letters, and its stop or nothing
        part = np.full((len(given), 2), len(size) - 1)
        part[plain, 0] = coded.indices.to_numpy()
        part[rest, 0] = len(heads) + len(_STOPS) + np.arange(len(rest))
        ends = np.frombuffer(given.buffers()[1], "int32")[given.offset + 1 : given.offset + 1 + len(given)]
        stopped = np.flatnonzero(plain & (stops == 1))
        place = np.zeros(256, "int64")
        place[list(_STOPS.encode())] = np.arange(len(_STOPS))
        part[stopped, 1] = len(heads) + place[np.frombuffer(given.buffers()[2], "uint8")[ends[stopped] - 1]]
        part = part.ravel()
        n = size[part]
        ids = flat[np.repeat((np.cumsum(size) - size)[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return n.reshape(-1, 2).sum(axis=1), ids

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the words, all of plain letters in lower case, has, and all their ids."""
        if self.fast is None or not len(words):
            return _flat([self.known.get(w) or self._piece(w) for w in words.to_pylist()])
        joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), _END)[0].as_py()
        ids = self.fast.encode_to_numpy(joined + _END, disallowed_special=())
        return np.diff(np.flatnonzero(self.ends[ids]), prepend=-1), ids.astype("uint16")

    def _words(self, words: list[str]) -> list[list[int]]:
        if len(self.known) > KNOWN_PIECES:  # what is used again moves to the younger of two generations
            self.known, self.known_before = {}, self.known
        known, out, rest = self.known, [], []
        for i, word in enumerate(words):
            core = word.rstrip(_STOPS)
            if core.isalpha() and (core.isascii() or max(core) < _PLAIN):
                head = core.lower()
                found = known.get(head) or self._piece(head)
                if len(core) < len(word):
                    found = found + (known.get(tail := word[len(core) :]) or self._piece(tail))
                out.append(found)
                continue
            if "<|" in word or not word.isprintable() or max(word, default="") >= _PLAIN:
                rest.append(i)
                out.append([])
                continue
            pieces = self.split(word.lower())
            if len(pieces) == 1:
                out.append(known.get(pieces[0]) or self._piece(pieces[0]))
            else:
                out.append([x for p in pieces for x in known.get(p) or self._piece(p)])
        slow = self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)
        for i, found in zip(rest, slow, strict=True):
            out[i] = found.ids
        return out

    def _piece(self, piece: str) -> list[int]:
        found = self.known_before.get(piece)
        if found is None:
            letters = piece if piece.isascii() else "".join(self.alphabet[b] for b in piece.encode())
            found = [t.id for t in self.tokenizer.model.tokenize(letters)]
        self.known[piece] = found
        return found


def _flat(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, parts), "int64", len(parts))
    return size, np.fromiter(itertools.chain.from_iterable(parts), "uint16", size.sum())


def repair(ids: np.ndarray, doc_sizes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (pairs) and symbols per document for ids below `base`."""
    last = np.zeros(len(ids), "bool")
    last[np.cumsum(doc_sizes) - 1] = True
    symbols, rules = ids.astype("uint16"), np.empty((0, 2), "uint16")
    while len(symbols) > 1 and (room := (1 << 16) - base - len(rules)) > 0:
        pairs = symbols[:-1].astype("uint32") << np.uint32(16) | symbols[1:]
        pairs[last[:-1]] = 0xFFFFFFFF  # no pair over a document's end
        chosen = _frequent(pairs, min(PAIRS_A_ROUND, room))
        if not len(chosen):
            break
        table = np.zeros(1 << _SLOTS, "uint16")
        slot = chosen * _HASH >> np.uint32(32 - _SLOTS)
        table[slot[::-1]] = np.arange(len(chosen), 0, -1, dtype="uint16")  # the more frequent of two in a slot
        kept = table[slot] == np.arange(1, len(chosen) + 1)
        chosen = chosen[kept]
        table[:] = 0
        table[slot[kept]] = np.arange(1, len(chosen) + 1, dtype="uint16")
        number = table[pairs * _HASH >> np.uint32(32 - _SLOTS)]
        at = np.flatnonzero(number)
        at = at[chosen[number[at] - 1] == pairs[at]]
        run = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1])
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        symbols[at] = base + len(rules) + number[at] - 1
        last[at] = last[at + 1]
        stays = np.ones(len(symbols), "bool")
        stays[at + 1] = False
        symbols, last = symbols[stays], last[stays]
        rules = np.concatenate([rules, np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], 1).astype("uint16")])
    return symbols, rules, np.diff(np.flatnonzero(last), prepend=-1)


def _frequent(pairs: np.ndarray, most: int) -> np.ndarray:
    ordered = np.sort(pairs)
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    count = np.diff(np.append(start, len(ordered)))
    often = (count >= LEAST_COUNT) & (ordered[start] != 0xFFFFFFFF)
    start, count = start[often], count[often]
    return ordered[start[np.argsort(-count, kind="stable")[:most]]]


def packed(doc_ids: np.ndarray, ids: np.ndarray, doc_sizes: np.ndarray, base: int) -> bytes:
    symbols, rules, per_doc = repair(ids, doc_sizes, base)
    head = np.array([base, len(doc_ids), len(rules), len(symbols), len(ids)], "<u8")
    first, start = (np.concatenate([[0], np.cumsum(n)]).astype("<u8") for n in (per_doc, doc_sizes))
    length = [1] * base
    for a, b in rules.tolist():  # a rule uses earlier symbols only
        length.append(length[a] + length[b])
    parts = (head, doc_ids.astype("<i8"), first, start, np.array(length[base:], "<u4"), rules.astype("<u2"), symbols.astype("<u2"))
    return MAGIC + b"".join(x.tobytes() for x in parts)


class IdFile:
    """A file's content; documents are decoded alone or all together."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token-id file")
        base, docs, rules, symbols, self.n_ids = (int(x) for x in np.frombuffer(data, "<u8", 5, 8))
        at = 48
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.first = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs).astype("int64")
        at += 16 * docs + 8
        self.start = np.frombuffer(data, "<u8", docs + 1, at).astype("int64")
        at += 8 * docs + 8
        # how many ids each symbol stands for
        self.length = np.concatenate([np.ones(base, "int64"), np.frombuffer(data, "<u4", rules, at)])
        self.base, self.pairs = base, np.frombuffer(data, "<u2", 2 * rules, at + 4 * rules).reshape(-1, 2)
        self.symbols = np.frombuffer(data, "<u2", symbols, at + 8 * rules)

    def ids(self, doc: int) -> np.ndarray:
        """The ids of the doc-th document alone."""
        return self._expanded(self.symbols[self.first[doc] : self.first[doc + 1]])

    def all_ids(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn, decoded about BLOCK_IDS at a time."""
        a = 0
        while a < len(self.doc_ids):
            b = max(a + 1, int(np.searchsorted(self.start, self.start[a] + BLOCK_IDS, "right")) - 1)
            yield from np.split(self._expanded(self.symbols[self.first[a] : self.first[b]]), self.start[a + 1 : b] - self.start[a])
            a = b

    def sizes(self) -> np.ndarray:
        """Ids per document, without decoding."""
        return np.diff(self.start)

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols; only the rules they use are expanded, all of one depth at a time."""
        n = self.length[symbols]
        out, at = np.empty(n.sum(), "<u4"), np.cumsum(n) - n
        while len(symbols):
            rule = symbols >= self.base
            out[at[~rule]] = symbols[~rule]
            left, right = self.pairs[symbols[rule] - self.base].T
            at = at[rule]
            symbols, at = np.concatenate([left, right]), np.concatenate([at, at + self.length[left]])
        return out


def write_id_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encodes and writes `docs` (doc_id long, text) in ascending doc_id order; the folder and its list of files.

    List: path, first_doc, last_doc, n_docs, n_ids; one row per file. Null texts count as empty and hold
    the end id alone. Rows with a null doc_id are left out, as they have no place in the
    order; repeated rows are each written, in any order. An empty table gives no file.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "id-files")
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    size = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    ordered = texts.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        encoder, taken = WordEncoder.cached(tokenizer_path), 0
        base = encoder.tokenizer.get_vocab_size()
        for batch in batches:
            names, rows = batch["doc_id"].to_numpy(zero_copy_only=False), batch["text"]
            for a, b in text_chunks(rows, SHARD_BYTES):
                held.append((names[a:b], *encoder.encode(rows[a:b])))
                taken += len(held[-1][1])
                if taken > SHARD_BYTES // 2:  # a range with much longer texts than others gets several files
                    yield _file(folder, held, base)
                    held, taken = [], 0
        if held:
            yield _file(folder, held, base)

    listing = "path string, first_doc long, last_doc long, n_docs long, n_ids long"
    path = f"{folder}/list"
    ordered.mapInArrow(write, listing).write.parquet(path)
    return folder, spark.read.schema(listing).parquet(path)


def _file(folder: str, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], base: int) -> pa.RecordBatch:
    names, ids, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
    system, root = pafs.FileSystem.from_uri(f"{folder}/files")
    system.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}.ids"
    with system.open_output_stream(f"{root}/.{name}.part") as out:
        out.write(packed(names, ids, sizes, base))
    system.move(f"{root}/.{name}.part", f"{root}/{name}")
    row = {"path": name, "first_doc": int(names[0]), "last_doc": int(names[-1]), "n_docs": len(names), "n_ids": len(ids)}
    return pa.RecordBatch.from_pylist([row])


def read_id_files(folder: str, listing: DataFrame, of: Callable[[IdFile], pd.DataFrame], schema: str) -> DataFrame:
    """`of` applied to each listed file, read from the folder; schema: that of its result.

    Columns file_start (ids of all files before) and what `of` returns.
    """
    spark = listing.sparkSession
    sizes = listing.toPandas().sort_values(["first_doc", "last_doc", "path"])  # one short row per file
    sizes["file_start"] = sizes["n_ids"].cumsum() - sizes["n_ids"]
    starts = spark.createDataFrame(sizes[["path", "file_start"]], "name string, file_start long")
    if sizes.empty:
        return spark.createDataFrame([], f"file_start long, {schema}")
    files = spark.read.format("binaryFile").load(f"{folder}/files").select(
        F.regexp_extract("path", "[^/]+$", 0).alias("name"), "content"
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, content in zip(batch["file_start"], batch["content"], strict=True):
                out = of(IdFile(bytes(content)))
                out.insert(0, "file_start", start)
                yield out

    return files.join(F.broadcast(starts), "name").select("file_start", "content").mapInPandas(read, f"file_start long, {schema}")


def documents_in(file: IdFile) -> pd.DataFrame:
    """Per document: ids before it in the file, their number, and the crc32 of the ids as little-endian uint32."""
    sizes = file.sizes()
    crc = [zlib.crc32(ids.tobytes()) for ids in file.all_ids()]
    return pd.DataFrame({"doc_id": file.doc_ids, "before": np.cumsum(sizes) - sizes, "n_tokens": sizes, "ids_crc32": crc})


DOCUMENTS_IN = "doc_id long, before long, n_tokens long, ids_crc32 long"
