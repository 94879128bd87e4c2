"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark, stored as compact hash arrays.

Tokens are words `[^\\x20\\x09-\\x0D]+`, with A-Z in lower case, and one end per text; a text
starts after two starts. A trigram (u, v, w) is placed in a shard by the hash of v. A v that a
sample shows to be so frequent that it would fill a shard is hot: its trigrams are placed
by v and w instead. This moves rows between files and changes no count.

One job counts. Each task packs its distinct trigrams into a blob per shard: as codes, the
sample's frequent words numbered by frequency, other words by their hashes, as differences
of sorted neighbours in planes of bytes. A task per shard merges them and writes one file to the
shared folder: the bigrams (v, w) with how many u precede them, the trigrams with their counts,
and the sums of contexts v and (u, v). Sums of a hot v, of contexts that end in it, and of words
are known in part there; they go on as blobs to ranges of hashes, where they are added up and
written. Files are named afresh by each attempt and the job's own result lists those
that count, so repeated tasks do no harm. Order 2 is the same with one u for all, and with bigrams' own counts.

A context (u, v) that occurs once has the sums 1, 1, 0, 0 and is not written: whoever finds the bigram
(u, v), but not the context, knows it. Sorted 64-bit keys are kept as a table of buckets by their first
bits and the next 40 bits; counts take four bits each, from 15 on they stand in a list.

Workers map the files into memory (shared folders that are no local path are copied to the
worker's temporary folder first) and look up the bigrams and trigrams of a few MB of text at a time.

Probabilities: discounts D1, D2, D3+ from counts of counts, interpolated with the
continuation distribution (number of distinct contexts of a word), itself discounted
likewise and interpolated with the even distribution over the V known types and one unknown.
"""

from __future__ import annotations

import json
import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcensus.llm.common import remainder, shared_folder, text_chunks, words_of

SHARD_TOKENS = 2_000_000
MAX_SHARDS = 1 << 14
SAMPLE_BYTES = 32 << 20
#: Words of the sample that get codes; others are passed on by their hashes.
VOCABULARY = 1 << 19
CHUNK_BYTES = 4 << 20
END, START = np.int64(-1), np.int64(-2)
FILE, COUNTS, HOT, WORD, PAIRS, TOP = 0, 1, 2, 3, 4, 5
_ROWS = "kind int, key long, path string, n array<long>"
#: Shards per range of words, and of the contexts that end in a hot word.
RANGE_SHARDS = 8
#: Bits of a word's code up to which three of them are sorted as one number.
_BITS = 21
_BUCKET = 8
_OPEN: dict[str, dict[str, np.ndarray]] = {}
_MOST_OPEN = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.view("uint64")
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_keys(context: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams: of the context's key, or of its hash mixed, and the last word's hash."""
    return _mixed(context + w.view("uint64"))


_STARTS = gram_keys(_mixed(np.array([START])), np.array([START]))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of tokens in order, hashes by code, tokens per text. The last code is the end."""
    codes, words, counts = words_of(texts)
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False).view("int64") if words else np.empty(0, "int64")
    ends = np.cumsum(counts)
    return np.insert(codes.astype("int64"), ends, len(words)), np.append(hashes, END), counts + 1


def _before(codes: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    """The code before each, within texts of so many codes."""
    before = np.concatenate([codes[:1], codes[:-1]])
    before[np.cumsum(counts) - counts] = start
    return before


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the keys begins."""
    new = np.zeros(len(keys[0]), "bool")
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _sizes(at: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(at, n))


def _distinct(v: np.ndarray, w: np.ndarray, u: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct triples of codes in order, with the sums of n, or with how often they occur."""
    if max(int(x.max(initial=0)) for x in (v, w, u)) >> _BITS:
        order = np.lexsort((u, w, v))
        v, w, u = v[order], w[order], u[order]
        at = _starts(v, w, u)
        return v[at], w[at], u[at], _sizes(at, len(v)) if n is None else np.add.reduceat(n[order], at)
    key = v << 2 * _BITS | w << _BITS | u
    if n is None:
        key.sort()
    else:
        order = np.argsort(key)
        key, n = key[order], n[order]
    at = _starts(key)
    n = _sizes(at, len(key)) if n is None else np.add.reduceat(n, at) if len(n) else n
    key, low = key[at], (1 << _BITS) - 1
    return key >> 2 * _BITS, key >> _BITS & low, key & low, n


def _packed(keys: list[np.ndarray], values: list[np.ndarray], known: int, rare: np.ndarray) -> bytes:
    """Distinct rows in order of one to three keys, which are codes, with values from 0 on.

    Codes from `known` on are places in `rare`, hashes in order; only those that occur go along.
    """
    far = [k >= known for k in keys]
    used = np.unique(np.concatenate([k[f] for k, f in zip(keys, far, strict=True)]))
    columns, firsts = [], np.zeros(1, "int64")[: len(keys[0])]
    for i, (key, f) in enumerate(zip(keys, far, strict=True)):
        key = key.copy()
        key[f] = known + np.searchsorted(used, key[f])
        at = np.arange(len(key)) if i == len(keys) - 1 else _starts(*keys[: i + 1])
        first = np.searchsorted(at, firsts)
        if i:
            columns.append(_sizes(first, len(at)))
        own = key[at]
        steps = np.diff(own, prepend=0)
        steps[first] = own[first]
        columns.append(steps)
        firsts = at
    columns += [*values, rare[used - known]]
    width = [max(1, -(-int(c.max(initial=0)).bit_length() // 8)) for c in columns[:-1]] + [8]
    planes = [np.ascontiguousarray(c.astype("<i8").view("u1").reshape(-1, 8)[:, :b].T).tobytes() for c, b in zip(columns, width, strict=True)]
    data = pickle.dumps((len(keys), [*map(len, columns)], width, b"".join(planes)), 5)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def _unpacked(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Keys, values and hashes of rare words as _packed was given them."""
    n_keys, sizes, width, data = pickle.loads(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True))
    columns, at = [], 0
    for n, b in zip(sizes, width, strict=True):
        out = np.zeros((n, 8), "u1")
        out[:, :b] = np.frombuffer(data, "u1", n * b, at).reshape(b, n).T
        columns.append(out.view("<i8").ravel())
        at += n * b
    keys = []
    for i in range(n_keys):
        steps = columns[2 * i]
        own = np.cumsum(steps)
        if i:
            group = columns[2 * i - 1]
            first = np.cumsum(group) - group
            own -= np.repeat(own[first] - steps[first], group)
            keys = [np.repeat(k, group) for k in keys]
        keys.append(own)
    return keys, columns[2 * n_keys - 1 : -1], columns[-1]


def _small(name: str, n: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers in four bits each, and a list of those from 15 on."""
    large = np.flatnonzero(n >= 15)
    low = np.minimum(n, 15).astype("uint8")
    low = np.append(low, np.zeros(len(low) % 2, "uint8"))
    return {f"{name}.n": low[::2] | low[1::2] << 4, f"{name}.at": _least(large), f"{name}.large": _least(n[large])}


def _numbers(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """The numbers at these places of those that _small packed."""
    n = (arrays[f"{name}.n"][at >> 1] >> ((at & 1) << 2).astype("uint8") & 15).astype("int64")
    large = np.flatnonzero(n == 15)
    if len(large):
        n[large] = arrays[f"{name}.large"][np.searchsorted(arrays[f"{name}.at"], at[large])]
    return n


def _four(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    return _numbers(arrays, name, (at[:, None] * 4 + np.arange(4)).ravel()).reshape(-1, 4)


def _least(n: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the least type that holds them."""
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


def _keys(name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted keys as buckets by the first bits, and the 40 bits after these."""
    bits = np.uint64(max(1, (len(keys) // _BUCKET).bit_length()))
    bucket = (keys >> np.uint64(64) - bits).astype("int64")
    rest = keys << bits
    return {
        f"{name}.table": np.searchsorted(bucket, np.arange((1 << int(bits)) + 1)).astype("uint32" if len(keys) < 1 << 32 else "int64"),
        f"{name}.main": (rest >> np.uint64(32)).astype("uint32"),
        f"{name}.check": (rest >> np.uint64(24)).astype("uint8"),
    }


def _find(arrays: dict[str, np.ndarray], name: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of those wanted that are among keys that _keys packed, and which are."""
    table, main, check = (arrays[f"{name}.{part}"] for part in ("table", "main", "check"))
    if not len(main):
        return np.empty(0, "int64"), np.empty(0, "int64")
    bits = np.uint64((len(table) - 1).bit_length() - 1)
    bucket, rest = (wanted >> np.uint64(64) - bits).astype("int64"), wanted << bits
    top = (rest >> np.uint64(32)).astype("uint32")
    at, size = table[bucket].astype("int64"), (table[bucket + 1] - table[bucket]).astype("int64")
    last = len(main) - 1
    while (most := int(size.max(initial=0))) > 0:  # the first place in the bucket that is not less
        half = size >> 1
        less = (main[np.minimum(at + half, last)] < top) & (size > 0)
        at += np.where(less, half + 1, 0)
        size = np.where(less, size - half - 1, half)
        if most == 1:
            break
    end = table[bucket + 1]
    seen = np.flatnonzero((at < end) & (main[np.minimum(at, last)] == top))
    at, end, top, low = at[seen], end[seen], top[seen], (rest[seen] >> np.uint64(24)).astype("uint8")
    while len(more := np.flatnonzero((at + 1 < end) & (check[at] < low) & (main[np.minimum(at + 1, last)] == top))):
        at[more] += 1
    same = check[at] == low
    return at[same], seen[same]


def _save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes arrays to one file under a new name, which it returns."""
    system, root = pafs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    name, at, parts = uuid.uuid4().hex, 0, {}
    for key, array in arrays.items():
        parts[key] = array.dtype.str, len(array), at
        at += -(-array.nbytes // 8) * 8
    head = json.dumps(parts).encode()
    head += b" " * (-len(head) % 8)
    with system.open_output_stream(f"{root}/{name}.kn") as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for array in arrays.values():
            out.write(np.ascontiguousarray(array).tobytes() + bytes(-array.nbytes % 8))
    return name


def _mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory; a worker process keeps the last ones open."""
    uri = f"{folder}/{name}.kn"
    if uri not in _OPEN:
        system, path = pafs.FileSystem.from_uri(uri)
        if system.type_name != "local":
            local = os.path.join(tempfile.gettempdir(), f"{name}.kn")
            if not os.path.exists(local):
                part = f"{local}.{os.getpid()}"
                pafs.copy_files(path, part, source_filesystem=system, destination_filesystem=pafs.LocalFileSystem())
                os.replace(part, local)
            path = local
        data = np.memmap(path, "u1", "r").view(np.ndarray)
        start = 8 + int.from_bytes(data[:8].tobytes(), "little")
        if len(_OPEN) >= _MOST_OPEN:
            del _OPEN[next(iter(_OPEN))]
        _OPEN[uri] = {
            key: np.frombuffer(data, kind, n, start + at) if n else np.empty(0, kind)
            for key, (kind, n, at) in json.loads(data[8:start].tobytes()).items()
        }
    return _OPEN[uri]


def discounts(n: list[int]) -> np.ndarray:
    """D0 = 0, D1, D2, D3+ from how many things were counted once to four times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))])


@dataclass
class KneserNey:
    """What workers need to find the arrays, and the model's few numbers."""

    folder: str
    shards: int
    hot: np.ndarray  # hashes in order
    hot_stats: np.ndarray
    bigrams: dict[int, str] = field(default_factory=dict)  # files by shard
    words: dict[int, str] = field(default_factory=dict)  # by range of words
    pairs: dict[int, str] = field(default_factory=dict)  # by range of contexts that end in a hot word
    d: np.ndarray = field(default_factory=lambda: discounts([0] * 4))
    d_cont: np.ndarray = field(default_factory=lambda: discounts([0] * 4))
    n: int = 0
    v: int = 0
    k: int = 0
    spare: float = 1.0  # the continuation distribution's mass that goes to the even one
    order: int = 2
    d_top: np.ndarray = field(default_factory=lambda: discounts([0] * 4))

    def _parts(self, files: dict[int, str], keys: np.ndarray, shards: int, rows: np.ndarray | None = None) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
        """The arrays of each file that the keys lead to, and the rows (of those given) that do."""
        shard = _shard(keys if rows is None else keys[rows], shards)
        for s, part in _grouped(shard):
            if s in files:
                yield _mapped(self.folder, files[s]), part if rows is None else rows[part]

    def logs(self, codes: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the model's probability of each token of texts, given as by `tokens`, and how often words occur, by code."""
        m, hashes = len(hashes), np.append(hashes, START)
        mixed = _mixed(hashes)
        is_hot = np.isin(hashes, self.hot)
        # words: occurrences, distinct contexts, sums as a context
        c, k, sums = np.zeros(m + 1, "int64"), np.zeros(m + 1, "int64"), np.zeros((m + 1, 4), "int64")
        for file, part in self._parts(self.words, mixed, _ranges(self.shards)):
            at, seen = _find(file, "words", mixed[part])
            c[part[seen]], k[part[seen]] = _numbers(file, "occurs", at), _numbers(file, "contexts", at)
        for file, part in self._parts(self.bigrams, mixed, self.shards, np.flatnonzero(~is_hot)):
            at, seen = _find(file, "contexts", mixed[part])
            sums[part[seen]] = _four(file, "context_sums", at)
        sums[is_hot] = self.hot_stats[np.searchsorted(self.hot, hashes[is_hot])]
        low = np.maximum(k - self.d_cont[np.minimum(k, 3)], 0) / max(self.k, 1) + self.spare / (self.v + 1)

        pair, of = np.unique(_before(codes, counts, m) * (m + 1) + codes, return_inverse=True)
        v, w = pair // (m + 1), pair % (m + 1)
        keys = gram_keys(mixed[v], hashes[w])
        place = np.where(is_hot[v], keys, mixed[v])
        n, found = np.zeros(len(keys), "int64"), np.zeros(len(keys) + 1, "bool")
        for file, part in self._parts(self.bigrams, place, self.shards):
            at, seen = _find(file, "bigrams", keys[part])
            n[part[seen]], found[part[seen]] = _numbers(file, "bigram_counts", at), True
        chance = _interpolated(n, sums[v], self.d, low[w])[of]
        if self.order == 2:
            return np.log10(chance), c[:m]

        # contexts of two words: each bigram of the texts, and last the two starts
        keys, ends = np.append(keys, _STARTS), np.append(w, m)
        sums = np.zeros((len(keys), 4), "int64")
        sums[found] = 1, 1, 0, 0
        hot = is_hot[ends]
        for file, part in (
            *self._parts(self.bigrams, mixed[ends], self.shards, np.flatnonzero(~hot)),
            *self._parts(self.pairs, keys, _ranges(self.shards), np.flatnonzero(hot)),
        ):
            at, seen = _find(file, "pairs", keys[part])
            sums[part[seen]] = _four(file, "pair_sums", at)
        context = _before(of, counts, len(pair))
        n = np.zeros(len(codes), "int64")
        rows = np.flatnonzero(found[of] & (sums[context, 0] > 0))
        wanted = gram_keys(keys[context[rows]], hashes[codes[rows]])
        for file, part in self._parts(self.bigrams, place[of[rows]], self.shards):
            at, seen = _find(file, "triples", wanted[part])
            n[rows[part[seen]]] = _numbers(file, "triple_counts", at)
        return np.log10(_interpolated(n, sums, self.d_top, chance, context)), c[:m]


def _interpolated(c: np.ndarray, stats: np.ndarray, d: np.ndarray, low: np.ndarray, context: np.ndarray | None = None) -> np.ndarray:
    """Discounted shares of contexts with these stats, and the shorter context's chances for the rest."""
    total = np.maximum(stats[:, 0], 1)
    gamma = np.where(stats[:, 0] > 0, stats[:, 1:] @ d[1:] / total, 1.0)
    if context is not None:
        total, gamma = total[context], gamma[context]
    return np.maximum(c - d[np.minimum(c, 3)], 0) / total + gamma * low


def _ranges(shards: int) -> int:
    return max(1, shards // RANGE_SHARDS)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(48)).astype("int64") * shards >> 16).astype("uint16")


def _grouped(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of each shard, in order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(shard[part[0]]), part


@dataclass
class _Counting:
    """What the tasks of a count need: where files go, and the sample's words by code, hot ones first."""

    folder: str
    shards: int
    order: int
    words: np.ndarray
    hot: int

    def packed(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """A blob per shard of texts given as by `tokens`."""
        hashes, place = np.unique(np.concatenate([h for _, h, _ in held]), return_inverse=True)
        order = np.argsort(self.words)
        at = order[np.minimum(np.searchsorted(self.words, hashes, sorter=order), len(order) - 1)]
        rare = self.words[at] != hashes
        at[rare] = len(self.words) + np.arange(rare.sum())
        rare = hashes[rare]
        cuts = np.cumsum([len(h) for _, h, _ in held])[:-1]
        w = np.concatenate([at[p][codes] for p, (codes, _, _) in zip(np.split(place, cuts), held, strict=True)])
        counts = np.concatenate([n for _, _, n in held])
        v = _before(w, counts, 0)
        v, w, u, n = _distinct(v, w, _before(v, counts, 0) if self.order == 3 else np.zeros_like(v))
        at = _starts(v, w)
        size = _sizes(at, len(v))
        hashes = np.concatenate([self.words, rare])
        mixed = _mixed(hashes)
        for s, part in _grouped(_shard(self.placed(v[at], w[at], hashes, mixed), self.shards)):
            rows = np.repeat(at[part] - (np.cumsum(size[part]) - size[part]), size[part]) + np.arange(size[part].sum())
            blob = _packed([v[rows], w[rows], u[rows]], [n[rows] - 1], len(self.words), rare)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], "int32"), "blob": [blob]})

    def placed(self, v: np.ndarray, w: np.ndarray, hashes: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        place = mixed[v]
        hot = np.flatnonzero(v < self.hot)
        place[hot] = gram_keys(place[hot], hashes[w[hot]])
        return place

    def merged(self, held: list[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]) -> list[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]:
        """Unpacked blobs of a shard as one."""
        known, all_rare = len(self.words), np.unique(np.concatenate([rare for _, _, rare in held]))
        for keys, _, rare in held:
            place = np.searchsorted(all_rare, rare) + known
            for key in keys:
                far = np.flatnonzero(key >= known)
                key[far] = place[key[far] - known]
        keys = [np.concatenate(x) for x in zip(*(keys for keys, _, _ in held), strict=True)]
        *keys, n = _distinct(*keys, np.concatenate([n for _, (n,), _ in held]) + 1)
        return [(keys, [n - 1], all_rare)]

    def written(self, shard: int, held: list[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Writes the file of a shard; the rows that its task passes on."""
        (((v, w, u), (n,), rare),) = self.merged(held)
        n += 1
        known, ranges = len(self.words), _ranges(self.shards)
        hashes = np.concatenate([self.words, rare])
        mixed = _mixed(hashes)
        at = _starts(v, w)
        bv, bw, occurs = v[at], w[at], np.add.reduceat(n, at)
        counts = _sizes(at, len(v)) if self.order == 3 else occurs
        keys = gram_keys(mixed[bv], hashes[bw])
        order = np.argsort(keys)
        arrays = _keys("bigrams", keys[order]) | _small("bigram_counts", counts[order])
        yield _row(COUNTS, shard, [(counts == i).sum() for i in range(1, 5)])

        at = _starts(bv)
        context, sums = bv[at], _sums(counts, at)
        hot = context < self.hot
        arrays |= _keyed("contexts", "context_sums", mixed[context[~hot]], sums[~hot])
        if hot.any():
            for s, part in _grouped(_shard(mixed[context[hot]], ranges)):
                yield _row(HOT, s, [], _packed([context[hot][part]], [*sums[hot][part].T], known, rare))

        order = np.argsort(bw, kind="stable")
        at = _starts(bw[order])
        word, contexts, occurs = bw[order][at], _sizes(at, len(bw)), np.add.reduceat(occurs[order], at)
        for s, part in _grouped(_shard(mixed[word], ranges)):
            yield _row(WORD, s, [], _packed([word[part]], [contexts[part], occurs[part]], known, rare))

        if self.order == 3:
            yield _row(TOP, shard, [(n == i).sum() for i in range(1, 5)])
            keys = gram_keys(gram_keys(mixed[u], hashes[v]), hashes[w])
            order = np.argsort(keys)
            arrays |= _keys("triples", keys[order]) | _small("triple_counts", n[order])
            order = np.argsort(v * len(hashes) + u)
            v, u, n = v[order], u[order], n[order]
            at = _starts(v, u)
            v, u, sums = v[at], u[at], _sums(n, at)
            keys, hot = gram_keys(mixed[u], hashes[v]), v < self.hot
            own = np.flatnonzero(~hot & (sums[:, 0] > 1))
            arrays |= _keyed("pairs", "pair_sums", keys[own], sums[own])
            hot = np.flatnonzero(hot)
            for s, part in _grouped(_shard(keys[hot], ranges)):
                part = hot[part]
                yield _row(PAIRS, s, [], _packed([v[part], u[part]], [*sums[part].T], known, rare))
        yield _row(FILE, shard, [], path=_save(self.folder, arrays))

    def unpacked_sums(self, kind: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Keys and sums that a shard passed on: of words, hot contexts (both by hash mixed), or contexts of two words."""
        keys, values, rare = _unpacked(blob)
        hashes = [np.concatenate([self.words, rare])[k] for k in keys]
        if kind == PAIRS:
            return gram_keys(_mixed(hashes[1]), hashes[0]), np.stack(values, 1)
        return _mixed(hashes[0]), np.stack(values, 1)

    def finished(self, kind: int, key: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Writes the added-up sums of a range, or passes them on for hot contexts."""
        ((keys, sums),) = _added(held)
        if kind == HOT:
            for k, s in zip(keys.view("int64").tolist(), sums, strict=True):
                yield _row(HOT, k, s)
        elif kind == PAIRS:
            more = (sums[:, 0] > 1) | (keys == _STARTS)
            yield _row(PAIRS, key, [], path=_save(self.folder, _keyed("pairs", "pair_sums", keys[more], sums[more])))
        else:
            k, n = sums.T
            path = _save(self.folder, _keys("words", keys) | _small("contexts", k) | _small("occurs", n))
            yield _row(WORD, key, [k.sum(), n.sum(), len(keys), *((k == i).sum() for i in range(1, 5))], path=path)


def _keyed(name: str, values: str, keys: np.ndarray, sums: np.ndarray) -> dict[str, np.ndarray]:
    order = np.argsort(keys)
    return _keys(name, keys[order]) | _small(values, sums[order].ravel())


def _sums(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the numbers from each place to the next: the sum, and how many are 1, 2, more."""
    return np.stack([np.add.reduceat(x, at) for x in (n, (n == 1).astype("int64"), (n == 2).astype("int64"), (n > 2).astype("int64"))], 1)


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys in order, with the sums of their numbers."""
    keys, stats = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    at = _starts(keys)
    return [(keys[at], np.add.reduceat(stats[order], at, axis=0))]


def _row(kind: int, key: int, n: list[int], blob: bytes | None = None, path: str | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "kind": pa.array([kind], "int32"), "key": pa.array([key], "int64"), "path": pa.array([path], "string"),
        "n": pa.array([[int(x) for x in n]], pa.list_(pa.int64())), "blob": pa.array([blob], "binary"),
    })


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> KneserNey:
    """The model of all rows of `docs`, of order 2 or 3. Null texts count as empty: their end is a token. Empty tables give an even model."""
    if order not in (2, 3):
        raise ValueError(f"order {order} is not 2 or 3")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(min(MAX_SHARDS, max(4, size / 6 / SHARD_TOKENS)))
    words, hot = _vocabulary(texts, size, shards)
    shared = spark.sparkContext.broadcast(_Counting(shared_folder(spark, "kneser-ney"), shards, order, words, hot))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for a, b in text_chunks(batch["text"], CHUNK_BYTES):
                held.append(tokens(batch["text"][a:b]))
                if sum(len(x[0]) for x in held) > SHARD_TOKENS:
                    yield from shared.value.packed(held)
                    held = []
        if held:
            yield from shared.value.packed(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, own, held = shared.value, None, []
        for batch in batches:  # in order of shards
            for shard, blob in zip(batch["shard"].to_pylist(), batch["blob"], strict=True):
                if held and shard != own:
                    yield from job.written(own, held)
                    held = []
                own = shard
                held.append(_unpacked(blob.as_buffer().to_pybytes()))
                if sum(len(x[0][0]) for x in held) > 3 * len(held[0][0][0]) + 2 * SHARD_TOKENS:
                    held = job.merged(held)
        if held:
            yield from job.written(own, held)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, own, held = shared.value, (0, 0), []
        for batch in batches:  # in order of kinds and ranges
            for i, blob in enumerate(batch["blob"]):
                if not blob.is_valid:
                    yield batch.slice(i, 1).drop_columns("blob")
                    continue
                group = batch["kind"][i].as_py(), batch["key"][i].as_py()
                if held and group != own:
                    yield from (rows.drop_columns("blob") for rows in job.finished(*own, held))
                    held = []
                own = group
                held.append(job.unpacked_sums(group[0], blob.as_buffer().to_pybytes()))
                if sum(len(x[0]) for x in held) > 3 * len(held[0][0]) + SHARD_TOKENS:
                    held = _added(held)
        if held:
            yield from (rows.drop_columns("blob") for rows in job.finished(*own, held))

    blobs = texts.mapInArrow(count, "shard int, blob binary").repartition(shards, "shard").sortWithinPartitions("shard")
    parts = blobs.mapInArrow(merge, f"{_ROWS}, blob binary").repartition(max(2, shards // 2), "kind", "key")
    rows = parts.sortWithinPartitions("kind", "key").mapInArrow(finish, _ROWS).collect()  # a few per file and hot word
    by_kind = {kind: [r for r in rows if r.kind == kind] for kind in (FILE, COUNTS, HOT, WORD, PAIRS, TOP)}
    model = KneserNey(shared.value.folder, shards, np.sort(words[:hot]), np.zeros((hot, 4), "int64"), order=order)
    model.bigrams, model.words, model.pairs = ({r.key: r.path for r in by_kind[kind]} for kind in (FILE, WORD, PAIRS))
    if not model.bigrams:
        return model
    total = lambda kind: np.array([r.n for r in by_kind[kind]]).sum(axis=0).tolist()
    model.d = discounts(total(COUNTS))
    if order == 3:
        model.d_top = discounts(total(TOP))
    place = {k: i for i, k in enumerate(_mixed(model.hot).view("int64").tolist())}
    for r in by_kind[HOT]:
        model.hot_stats[place[r.key]] = r.n
    model.k, model.n, model.v, *times = total(WORD)
    model.d_cont = discounts(times)
    model.spare = float(model.d_cont[1:] @ [times[0], times[1], model.v - times[0] - times[1]]) / model.k
    return model


def _vocabulary(texts: DataFrame, size: int, shards: int) -> tuple[np.ndarray, int]:
    """Hashes of the most frequent words of a sample of texts, in that order, the start of a text first; how many are hot: over a quarter of a shard's tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch["text"], CHUNK_BYTES):
                codes, hashes, _ = tokens(batch["text"][a:b])  # the start stands for the sample's tokens
                yield pa.RecordBatch.from_pydict({"w": np.append(hashes, START), "n": np.append(np.bincount(codes, minlength=len(hashes)), len(codes))})

    sample = texts.filter(remainder("text", max(1, size // SAMPLE_BYTES)) == 0).mapInArrow(count, "w long, n long")
    counts = sample.groupBy("w").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "w").limit(VOCABULARY).toArrow()
    w, n = (top[c].to_numpy() for c in ("w", "n"))
    w, n = np.append(START, w[w != START]), np.append(n[w == START], n[w != START])
    return w, max(1, int((n > n[0] / (4 * shards)).sum())) if len(n) else 1


def scored(docs: DataFrame, model: KneserNey) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text).

    score: the model's log10 probability of the text; base_score: that of single tokens with
    one added to each count. Null and empty texts have one token, the end. Repeated rows are scored one by one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for a, b in text_chunks(batch["text"], CHUNK_BYTES):
                codes, hashes, counts = tokens(batch["text"][a:b])
                logs, occurs = m.logs(codes, hashes, counts)
                start = np.cumsum(counts) - counts
                base = np.log10((occurs + 1) / (m.n + m.v + 1))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"][a:b],
                    "n_tokens": counts.astype("int64"),
                    "n_known": np.add.reduceat((occurs > 0).astype("int64")[codes], start),
                    "train_tokens": np.full(b - a, m.n, "int64"),
                    "base_score": np.add.reduceat(base[codes], start),
                    "score": np.add.reduceat(logs, start),
                })

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, schema)
