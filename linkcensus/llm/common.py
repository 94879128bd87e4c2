"""Helpers of the training-data operators: shared folders, batches, held-out rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a task turns into arrays at a time.
CHUNK_CHARS = 4_000_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a URI, that the driver and all executors can read.

    It lies in `spark.checkpoint.dir`. Where that is unset, as in local tests, a
    temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="linkcensus-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo `mod`; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def chunks(texts: Sequence[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` characters each; a longer text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def coded_pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Texts, none of them null, cut at single blanks: codes of all pieces, the distinct pieces, pieces per text.

    Neighbouring blanks give empty pieces; a text always has at least one piece.
    """
    pieces = pc.split_pattern(texts, " ")
    coded = pc.list_flatten(pieces).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype("int64")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, counts


def coded_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """As `coded_pieces`, with the distinct pieces as a list."""
    codes, distinct, counts = coded_pieces(texts)
    return codes, distinct.to_numpy(zero_copy_only=False).tolist(), counts


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case: codes in order, the distinct words, words per text. Null: none."""
    plain = pc.ascii_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), "[\\t-\\r]", " "))
    codes, distinct, counts = coded_words(plain)
    if "" in distinct:
        full = codes != distinct.index("")
        upto = np.concatenate([[0], np.cumsum(full)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        codes, counts = codes[full], np.diff(upto[ends])
    return codes, distinct, counts


def text_chunks(texts: pa.Array, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a longer text is a range of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + most, "right")))
        yield start, stop
        start = stop
