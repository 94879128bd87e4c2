"""Language identification by n-gram filters that hold a bit per language.

Training counts 4-byte n-grams of letters and word limits per language in Spark. A
language contains an n-gram if its share there is at least MIN_SHARE, and at least RATIO of
the largest share in any language. All (n-gram, language mask) pairs go into one
bit-sliced Bloom filter: a table of masks in which each n-gram sets its languages' bits at
HASHES slots, so that one lookup, the AND of those slots, gives every language that
contains the n-gram. A text's count per language is corrected by that language's rate of
false positives, which follows from how full its bits are; the largest count decides.

The filter has a proven bound: at most 1 / MIN_SHARE n-grams per language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcensus.llm.common import chunks

MIN_SHARE = 4e-6
RATIO = 0.25
HASHES = 3
SLOTS_PER_GRAM = 16
_SEEDS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str | None) -> str:
    """Lower-case words with one space around each; empty if the text has no letter."""
    words = _NO_LETTERS.sub(" ", text.lower()).strip(" ") if text else ""
    return f" {words} " if any(map(str.isalpha, words)) else ""


def _grams(data: bytes) -> np.ndarray:
    """Every 4-byte window as an integer, in no special order."""
    return np.concatenate([np.frombuffer(data, "<u4", (len(data) - r) // 4, r) for r in range(min(4, len(data)))])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> "LanguageFilter":
    """The filter learnt from all rows with a text and a language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                texts = texts.tolist()
                for a, b in chunks(texts):
                    gram, n = np.unique(_grams("".join(map(letters_only, texts[a:b])).encode()), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": gram.astype("int64"), "n": n})

    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    counts = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    kept = shares.filter(F.col("share") >= MIN_SHARE).select("lang", "gram", "share").toPandas()
    learnt = sorted(kept["lang"].unique())
    kept = kept[kept["share"] >= RATIO * kept.groupby("gram")["share"].transform("max")]
    return LanguageFilter(learnt, kept["gram"].to_numpy("uint64"), kept["lang"].map({x: i for i, x in enumerate(learnt)}).to_numpy())


class LanguageFilter:
    """The table of masks: (slots, words of 8 languages)."""

    def __init__(self, langs: list[str], grams: np.ndarray, lang_of: np.ndarray):
        self.langs = langs
        self.bits = max(10, int(SLOTS_PER_GRAM * max(1, len(np.unique(grams)))).bit_length())
        self.table = np.zeros((-(-max(1, len(langs)) // 8), 1 << self.bits), "uint8")
        for lang in range(len(langs)):
            own = grams[lang_of == lang]
            for seed in _SEEDS:
                self.table[lang // 8, self._slots(own, seed)] |= np.uint8(1 << lang % 8)
        fill = [float(np.mean(self.table[i // 8] >> (i % 8) & 1)) for i in range(len(langs))]
        self.false_rate = np.array([min(f**HASHES, 0.999) for f in fill])

    def _slots(self, grams: np.ndarray, seed: int) -> np.ndarray:
        mixed = grams.astype("uint64") * np.uint64(seed)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return mixed >> np.uint64(64 - self.bits)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each text has a letter, and how many of its n-grams each language contains, corrected."""
        data = [letters_only(x).encode() for x in texts]
        size = np.array([max(0, len(x) - 3) for x in data])
        hits = np.zeros((len(texts), len(self.langs)))
        whole = b"".join(x + b"\0\0\0" for x in data)  # windows over two texts hold a zero byte
        ends = np.cumsum([len(x) + 3 for x in data])
        for r in range(min(4, len(whole))):
            grams = np.frombuffer(whole, "<u4", (len(whole) - r) // 4, r)
            cuts = np.clip(-(-(np.concatenate([[0], ends]) - r) // 4), 0, len(grams))
            for word, table in enumerate(self.table):
                masks = table[self._slots(grams, _SEEDS[0])]
                for seed in _SEEDS[1:]:
                    masks = masks & table[self._slots(grams, seed)]
                masks[_has_zero(grams)] = 0
                for i in range(8 * word, min(8 * word + 8, len(self.langs))):
                    seen = np.concatenate([[0], np.cumsum(masks >> np.uint8(i % 8) & 1, dtype="int64")])
                    hits[:, i] += seen[cuts[1:]] - seen[cuts[:-1]]
        corrected = np.clip((hits - size[:, None] * self.false_rate) / (1 - self.false_rate), 0, None)
        return np.array([len(x) > 0 for x in data], dtype="bool"), corrected

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score: the winner's part of all corrected counts. Ties go to the first name in order."""
        known, counts = self.counts(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        total = counts.sum(axis=1)
        best = counts.argmax(axis=1)
        score = np.where(total > 0, counts.max(axis=1) / np.where(total > 0, total, 1), 1 / len(self.langs))
        return [self.langs[i] if k else "und" for i, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def _has_zero(grams: np.ndarray) -> np.ndarray:
    return (grams - np.uint32(0x01010101)) & ~grams & np.uint32(0x80808080) != 0


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with lang_pred and score, in the columns `into`.

    `und` and 0 if the text is null or has no letter, or nothing was learnt. A text
    with letters but no known n-gram gets the first learnt language, with an even score.
    Repeated rows are judged one by one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        texts, langs, scores = texts.fillna("").tolist(), [], []
        for a, b in chunks(texts):
            lang, score = held.value.predict(texts[a:b])
            langs += lang
            scores += score.tolist()
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    found = docs.withColumn("_found", predicted(F.col(text_col)))
    return found.withColumns({into[0]: F.col("_found.lang_pred"), into[1]: F.col("_found.score")}).drop("_found")
