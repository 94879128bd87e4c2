"""N-gram Jaccard join by PartEnum signatures.

A text's set holds its distinct shingles of five words. Two sets with 100 |A and B| >= 75 |A or B| differ
in at most (|A| + |B|) / 7 shingles. Sets are taken in bands of sizes, (r / 2, r] for r a power
of two; a set also joins the next band if a partner there is large enough. In a band the domain of shingles is divided into n(r)
partitions by hash, slightly more than 2 r / 7, so that two similar sets agree on at least g
partitions, g = n(r) less the most differences the smaller one allows. A signature is a partition with all
of a set's shingles in it.

Of a set's signatures only the first n(r) - g + 1 in one order for all sets are needed: if two sets share
g of them, the first shared one is among those of each. The order puts signatures last that consist of frequent shingles
(known from a sample; this changes no result) and empty partitions after these.

Sets that share a signature are candidates. In buckets of up to CROWD distinct sets all pairs are; larger
ones give pairs with a few leaders only, and their other pairs are settled after the links found so far
have joined most members: those outside the largest component of their crowd are compared, in
blocks, with all members of the crowd. So each pair that shares a signature is either compared or known to be connected.
Pairs are compared first by counts of shingles per hash slot, a lower bound of their
difference that takes a sixteenth of the bytes, and then exactly.

Equal sets are one node throughout. Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from linkcensus.llm.common import remainder, stored, text_chunks, words_of
from linkcensus.llm.components import components

WORDS = 5
CROWD, LEADERS = 48, 3
BLOCK = 256
SAMPLE_MOD = 32
POPULAR_SHARE = 2e-4
_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted hashes, all in a row, and how many each has."""
    codes, words, counts = words_of(texts)
    if not len(codes):
        return np.empty(0, "uint64"), np.zeros(len(texts), "int64")
    hashes = _mix(pd.util.hash_array(np.array(words, dtype=object), categorize=False))[codes]
    with np.errstate(over="ignore"):
        whole = np.zeros(len(codes) + WORDS - 1, "uint64")
        whole[: len(codes)] = hashes
        runs = np.zeros(len(codes), "uint64")
        for i in range(WORDS):
            runs = runs * _MULTIPLY + whole[i : i + len(codes)]
        runs = _mix(runs)
    start = np.cumsum(counts) - counts
    n = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    text = np.repeat(np.arange(len(texts)), n)
    values = runs[at]
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):  # the whole sequence is the shingle
        own = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for h in hashes[start[i] : start[i] + counts[i]]:
                own = own * _MULTIPLY + h
        values[np.cumsum(n)[i] - 1] = _mix(np.array([own], "uint64"))[0]
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (text[1:] != text[:-1])])
    return values[new], np.bincount(text[new], minlength=len(texts))


def node_ids(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set, as int64; sets without shingles get 0."""
    some = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), "uint64")
    if len(some):
        sums = np.add.reduceat(_mix(values ^ _MULTIPLY), (np.cumsum(sizes) - sizes)[some])
        out[some] = _mix(sums + sizes[some].astype("uint64"))
    return out.view("int64")


def partitions(r: int) -> int:
    """Partitions of the domain in the band of sizes up to r."""
    most = 2 * r // 7
    return max(most + 2, -(-(most + 1) * 9 // 8))


def signatures(values: np.ndarray, sizes: np.ndarray, popular: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures that each set needs, and the row of the set. `popular`: sorted shingles that go last."""
    start = np.cumsum(sizes) - sizes
    own = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype("int64")
    own = np.where(own < sizes, 2 * own, own)
    out, rows = [], []
    for band in (0, 1):
        r_of = own << band
        top = np.minimum(4 * sizes // 3, r_of)  # the largest partner in this band
        ok = (sizes >= 3) & (top >= (sizes if band == 0 else own + 1))
        for r in np.unique(r_of[ok]).tolist():
            some = np.flatnonzero(ok & (r_of == r))
            n, size = partitions(r), sizes[some]
            at = np.repeat(start[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            shingle = values[at]
            cell = np.repeat(np.arange(len(some)) * n, size) + (shingle % np.uint64(n)).astype("int64")
            content = np.zeros(len(some) * n, "uint64")
            np.add.at(content, cell, _mix(shingle))
            rank = np.full(len(content), 2, "uint8")
            rank[cell] = 1
            rank[cell[~_among(shingle, popular)]] = 0
            place = np.tile(np.arange(n, dtype="uint64"), len(some))
            signature = _mix(content * _MULTIPLY + place + np.uint64(r << 24))
            set_of = np.repeat(np.arange(len(some)), n)
            order = np.lexsort((signature, rank, set_of))
            needed = np.repeat((size + top[some]) // 7 + 1, n)
            first = order[np.tile(np.arange(n), len(some)) < needed]
            out.append(signature[first])
            rows.append(some[set_of[first]])
    if not out:
        return np.empty(0, "int64"), np.empty(0, "int64")
    return np.concatenate(out).view("int64"), np.concatenate(rows)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), "bool")
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _counts(shingles: np.ndarray) -> bytes:
    """Shingles per hash slot, half as many slots as shingles, up to a power of two."""
    slots = 1 << max(4, int(len(shingles) // 2).bit_length())
    slot = (_mix(shingles) & np.uint64(slots - 1)).astype("int64")
    return np.minimum(np.bincount(slot, minlength=slots), 255).astype("uint8").tobytes()


def may_be_similar(a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    """False only if the sets with these counts differ in more than (n_a + n_b) / 7 shingles."""
    if 4 * min(n_a, n_b) < 3 * max(n_a, n_b):
        return False
    x, y = (np.frombuffer(c, "uint8").astype("int64") for c in (a, b))
    if max(x.max(), y.max()) == 255:
        return True  # a slot may have more
    size = min(len(x), len(y))
    x, y = x.reshape(-1, size).sum(0), y.reshape(-1, size).sum(0)
    return 7 * int(np.abs(x - y).sum()) <= n_a + n_b


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 |A and B| >= 75 |A or B| for two sorted sets."""
    shared = int(_among(a, b).sum()) if len(a) <= len(b) else int(_among(b, a).sum())
    return 100 * shared >= 75 * (len(a) + len(b) - shared)


def similar_groups(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) of docs (doc_id long, text): the component's smallest doc_id.

    Null, empty and wordless texts have no shingle and are linked with nothing. Rows with
    equal sets are linked. Repeated rows are each returned. A null doc_id is returned as it is and never
    gives a component its name, unless all its members are null. Empty tables give an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    table = stored(texts.mapInArrow(_nodes, "doc_id long, n_shingles long, node long"), "jaccard-nodes")
    links = _links(texts, table.filter("n_shingles > 0"), crowd)
    roots = components(links)
    first = table.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("own"))
    named = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("own").alias("component_id"))
    of_node = named.join(smallest, "root").select("node", "component_id")
    sets = table.filter("n_shingles > 0").join(of_node, "node").select("doc_id", "n_shingles", "component_id", "node")
    return sets.unionByName(table.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "node"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """`docs` with the smallest doc_id of each component only, and one row of those with that id; see similar_groups.

    Rows without a shingle and rows without an id stay.
    """
    groups = similar_groups(docs)
    go = groups.filter("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    repeated = groups.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("_again"))
    kept = docs.join(go, "doc_id", "left_anti").join(repeated, "doc_id", "left")
    return kept.filter("_again is null").drop("_again").unionByName(kept.filter("_again").drop("_again").dropDuplicates(["doc_id"]))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_chunks(batch["text"]):
            values, sizes = shingle_sets(batch["text"][a:b])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"][a:b], "n_shingles": sizes.astype("int64"), "node": node_ids(values, sizes)})


def _links(texts: DataFrame, table: DataFrame, crowd: int) -> DataFrame:
    """(a, b): nodes that are similar, enough of them to join all that are connected."""
    signed = texts.select("text").mapInArrow(_signed(_popular(texts)), "signature long, node long")
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = signed.repartition(parts, "signature").sortWithinPartitions("signature", "node")
    found = stored(ordered.mapInArrow(lambda rows: _candidates(rows, crowd), "crowd long, a long, b long").distinct(), "jaccard-candidates")
    pairs = found.filter("b is not null").select("a", "b").distinct()
    crowds = found.filter("b is null").select("crowd", F.col("a").alias("node"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowds.select("node")).distinct()
    places = table.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    shape = "node long, n int, counts binary, shingles binary"
    sets = texts.join(places.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets, shape)
    if not table.filter("doc_id is null").isEmpty():  # sets that only rows without an id have are found by node
        nameless = texts.filter("doc_id is null").mapInArrow(_sets, shape)
        sets = sets.unionByName(nameless.join(places.filter("doc_id is null").select("node"), "node", "left_semi"))
    sets = stored(sets.dropDuplicates(["node"]), "jaccard-sets")
    links = stored(_verified(pairs, sets), "jaccard-links")
    if crowds.isEmpty():
        return links
    return links.unionByName(_crowd_links(crowds, links, sets))


def _popular(texts: DataFrame) -> np.ndarray:
    """Shingles in at least POPULAR_SHARE, and three, of a sample of the texts; at most 1 / POPULAR_SHARE times the mean size."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch["text"]):
                values, sizes = shingle_sets(batch["text"][a:b])
                one, n = np.unique(values, return_counts=True)
                yield pa.RecordBatch.from_pydict({"shingle": one.view("int64"), "n": n})

    sample = texts.select("text").filter(remainder("text", SAMPLE_MOD) == 0)
    least = max(3, POPULAR_SHARE * sample.count())
    often = sample.mapInArrow(shingles, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = often.select("shingle").toPandas()["shingle"].to_numpy("int64")
    return np.sort(found.view("uint64"))


def _signed(popular: np.ndarray):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch["text"]):
                values, sizes = shingle_sets(batch["text"][a:b])
                nodes = node_ids(values, sizes)
                once = np.zeros(len(nodes), "bool")
                once[np.unique(nodes, return_index=True)[1]] = True
                values, sizes, nodes = values[np.repeat(once, sizes)], sizes[once], nodes[once]
                found, row = signatures(values, sizes, popular)
                yield pa.RecordBatch.from_pydict({"signature": found, "node": nodes[row]})

    return sign


def _candidates(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From rows in order of signature and node: pairs of small buckets (crowd null), and of large ones the members
    (b null) and pairs with the leaders. A bucket of over `most` is passed on as it comes and never held."""
    signature, node = np.empty(0, "int64"), np.empty(0, "int64")
    large: tuple[int, np.ndarray] | None = None  # the signature of an open large bucket and its leaders
    for batch in batches:
        signature = np.concatenate([signature, batch["signature"].to_numpy()])
        node = np.concatenate([node, batch["node"].to_numpy()])
        if large and len(signature):
            n = int(np.searchsorted(signature, large[0], "right"))
            yield _crowd(large, node[:n])
            signature, node = signature[n:], node[n:]
            if len(signature):
                large = None
        if not len(signature):
            continue
        last = int(np.searchsorted(signature, signature[-1], "left"))
        yield from _buckets(signature[:last], node[:last], most)
        signature, node = signature[last:], node[last:]
        if len(np.unique(node)) > most:
            large = (int(signature[0]), np.unique(node)[:LEADERS])
            yield _crowd(large, node)
            signature, node = signature[:0], node[:0]
    yield from _buckets(signature, node, most)


def _found(crowd: np.ndarray | list, a: np.ndarray, b: np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, "int64") for x in (crowd, a, b)], ["crowd", "a", "b"])


def _crowd(large: tuple[int, np.ndarray], nodes: np.ndarray) -> pa.RecordBatch:
    nodes = np.unique(nodes)
    a, b = np.repeat(large[1], len(nodes)), np.tile(nodes, len(large[1]))
    a, b = a[a != b], b[a != b]
    none = [None] * len(nodes)
    crowd = pa.concat_arrays([pa.array([large[0]] * len(nodes), "int64"), pa.nulls(len(a), "int64")])
    return _found(crowd, np.concatenate([nodes, np.minimum(a, b)]), pa.concat_arrays([pa.array(none, "int64"), pa.array(np.maximum(a, b), "int64")]))


def _buckets(signature: np.ndarray, node: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    if not len(signature):
        return
    new = np.concatenate([[True], (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])])
    signature, node = signature[new], node[new]
    start = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
    size = np.diff(np.append(start, len(signature)))
    left, right = [], []
    for m in range(2, most + 1):
        first = start[size == m]
        if len(first):
            i, j = np.triu_indices(m, 1)
            left.append(node[(first[:, None] + i).ravel()])
            right.append(node[(first[:, None] + j).ravel()])
    if left:
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
        yield _found(pa.nulls(len(pairs), "int64"), np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
    for at, m in zip(start[size > most].tolist(), size[size > most].tolist(), strict=True):
        own = node[at : at + m]
        yield _crowd((int(signature[at]), own[:LEADERS]), own)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_chunks(batch["text"]):
            values, sizes = shingle_sets(batch["text"][a:b])
            parts = np.split(values, np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_pydict({
                "node": node_ids(values, sizes),
                "n": sizes.astype("int32"),
                "counts": [_counts(p) for p in parts],
                "shingles": [p.tobytes() for p in parts],
            })


@F.arrow_udf(BooleanType())
def _may_be(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    rows = zip(a.to_pylist(), b.to_pylist(), n_a.to_pylist(), n_b.to_pylist(), strict=True)
    return pa.array([may_be_similar(*row) for row in rows], "bool")


@F.arrow_udf(BooleanType())
def _is(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similar(np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64")) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], "bool")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""

    def side(name: str, column: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col(column).alias(f"{column}_{name}"))

    both = pairs.join(side("a", "counts"), "a").join(side("b", "counts"), "b")
    close = stored(both.filter(_may_be("counts_a", "counts_b", "n_a", "n_b")).select("a", "b"), "jaccard-close")
    whole = close.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")
    return whole.filter(_is("shingles_a", "shingles_b")).select("a", "b")


def _crowd_links(crowds: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of members of large buckets outside the largest component of their crowd, with any member.

    Large buckets that share a member are one crowd.
    """
    anchor = crowds.groupBy("crowd").agg(F.min("node").alias("a"))
    crowd = components(crowds.join(anchor, "crowd").select("a", F.col("node").alias("b"))).withColumnRenamed("root", "crowd")
    member = crowd.join(components(links), "node", "left").withColumn("part", F.coalesce("root", "node")).select("node", "crowd", "part")
    member = stored(member, "jaccard-crowds")
    sizes = member.groupBy("crowd", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("crowd").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.sum("n").alias("members"))
    main = main.join(sizes, "crowd").groupBy("crowd", "main", "members").agg(F.sum(F.when(F.col("part") != F.col("main"), F.col("n")).otherwise(0)).alias("strays"))
    main = main.filter("strays > 0")
    dealt = member.join(main, "crowd").join(sets.select("node", "shingles"), "node")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    every = F.sequence(F.lit(0), blocks("members") - 1)
    own = F.pmod(F.xxhash64("node"), blocks("members")).cast("int")
    strays = dealt.filter("part <> main").withColumn("i", F.pmod(F.xxhash64("node"), blocks("strays")).cast("int")).withColumn("j", F.explode(every))
    others = dealt.withColumn("j", own).withColumn("i", F.explode(F.sequence(F.lit(0), blocks("strays") - 1)))
    columns = ["crowd", "i", "j", "node", "part", "shingles"]
    keys = ["crowd", "i", "j"]
    others = others.select(*(F.col(c).alias(f"other_{c}") for c in columns))
    met = strays.select(columns).groupBy(keys).cogroup(others.groupBy([f"other_{k}" for k in keys]))
    return met.applyInPandas(_across, "a long, b long").distinct()


def _across(strays: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """For each stray a link to each other component that it is similar to a member of."""
    others = others.rename(columns=lambda c: c.removeprefix("other_"))
    sets = [np.frombuffer(x, "uint64") for x in others["shingles"]]
    flat = np.concatenate(sets) if sets else np.empty(0, "uint64")
    size = np.array([len(x) for x in sets], "int64")
    owner = np.repeat(np.arange(len(sets)), size)
    out, part = [], others["part"].to_numpy()
    for node, own_part, blob in zip(strays["node"], strays["part"], strays["shingles"], strict=True):
        own = np.frombuffer(blob, "uint64")
        shared = np.bincount(owner[_among(flat, own)], minlength=len(sets))
        linked = np.flatnonzero((100 * shared >= 75 * (size + len(own) - shared)) & (part != own_part))
        _, first = np.unique(part[linked], return_index=True)
        out += [(node, int(others["node"].iat[i])) for i in linked[first]]
    return pd.DataFrame(out, columns=["a", "b"])
