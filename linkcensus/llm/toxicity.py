"""Toxicity: a support vector machine with a gap-weighted subsequence kernel and Nystroem landmarks.

Sentences are judged by their units: words in lower case, without accents and without marks
inside them, and runs of single letters as one unit. Units longer than LONGEST letters become
overlapping pieces. The kernel of two units sums, over all subsequences of three letters
that span at most SPAN letters, the products of their weights DECAY ** span; a letter put
into an insult or taken out of it changes few of them. Each unit is divided by the norm
that its length gives. A sentence's value is its best unit's, a text's its best sentence's.

Training takes sentences with the label of their text (at most TRAIN_DOCS documents of each class,
the first by hash). A toxic text needs one toxic unit only, so training goes in rounds: each
toxic text names its most telling unit, a machine is trained on these against units of
clean texts, the clean units it gets wrong join, and texts name their units anew. Landmarks are the
units named most often and clean ones; K(x, landmarks) K(landmarks, landmarks)^-1/2 is the feature map,
and a linear machine with squared hinge loss is found by Newton steps. As each subsequence's
part in the result is fixed then, landmarks and weights fold into one value per subsequence.
A logistic curve over the training texts' values gives the score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcensus.llm.common import text_chunks, words_of

TRAIN_DOCS = 3_000
CLEAN_UNITS = 6_000
HARD_UNITS = 3_000
LANDMARKS = 240
GRAM = 5
ROUNDS = 4
DECAY, SPAN, LONGEST = 0.6, 6, 24
SOFTNESS = 2e-3
SOLVED_ROWS = 2_000  # rows of a step of the solver
_NONE = -4.0  # value of a text without a unit
_LETTERS = 32
_OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_MARKS = re.compile(r"[\W_]+")


def _code_table() -> np.ndarray:
    """Code points to 1-31: letters without accents, then word limits, digits and other scripts by remainder."""
    table = 29 + np.arange(0x110000, dtype="uint8") % 3
    for point in range(0x250):
        base = unicodedata.normalize("NFKD", chr(point))[0].lower()
        if "a" <= base <= "z":
            table[point] = ord(base) - ord("a") + 1
        elif base.isdigit():
            table[point] = 28
    table[ord("^")] = 27
    return table


_CODES = _code_table()


def unit_of(word: str) -> str:
    """A word without marks, between limits; empty if nothing is left."""
    word = word if word.isalpha() else _MARKS.sub("", word)
    return f"^{word.lower()}^" if word else ""


def _pieces(unit: str) -> list[str]:
    if len(unit) <= LONGEST:
        return [unit]
    return [unit[i : i + LONGEST] for i in range(0, len(unit) - LONGEST // 2, LONGEST // 2)]


def units_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Units of texts: codes in order, the distinct units, units per text."""
    codes, words, counts = words_of(texts)
    units = [unit_of(w) for w in words]
    text_of = np.repeat(np.arange(len(texts)), counts)
    single = np.array([len(u) == 3 for u in units], "bool")[codes] if len(codes) else np.empty(0, "bool")
    spelled: dict[str, int] = {}
    more_text, more_code = [], []
    at = np.flatnonzero(single)
    if len(at):
        cuts = np.flatnonzero((np.diff(at) != 1) | (text_of[at[1:]] != text_of[at[:-1]])) + 1
        for run in np.split(at, cuts):
            if len(run) >= 3:
                unit = "^" + "".join(units[c][1] for c in codes[run]) + "^"
                more_text.append(text_of[run[0]])
                more_code.append(len(units) + spelled.setdefault(unit, len(spelled)))
    units += spelled
    cut = {i: _pieces(u) for i, u in enumerate(units) if len(u) > LONGEST}
    kept = np.array([len(u) >= 3 for u in units], "bool")
    all_text, all_code = np.concatenate([text_of, np.array(more_text, "int64")]), np.concatenate([codes, np.array(more_code, "int64")])
    for i, pieces in cut.items():
        first = len(units)
        units += pieces
        own = all_text[all_code == i]
        all_text = np.concatenate([all_text, np.repeat(own, len(pieces))])
        all_code = np.concatenate([all_code, np.tile(np.arange(first, first + len(pieces)), len(own))])
        kept[i] = False
        kept = np.concatenate([kept, np.ones(len(pieces), "bool")])
    stays = kept[all_code] if len(all_code) else np.empty(0, "bool")
    all_text, all_code = all_text[stays], all_code[stays]
    order = np.argsort(all_text, kind="stable")
    return all_code[order], units, np.bincount(all_text, minlength=len(texts))


class Units:
    """Distinct units as matrices of letter codes by length."""

    def __init__(self, units: list[str]):
        self.n = len(units)
        length = np.array([len(u) for u in units], "int64")
        flat = _CODES[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")]
        first = np.cumsum(length) - length
        self.groups = []
        for size in np.unique(length):
            if 3 <= size <= LONGEST:
                rows = np.flatnonzero(length == size)
                self.groups.append((rows, flat[first[rows][:, None] + np.arange(size)].astype("int32")))

    def values(self, table: np.ndarray, empty: float = 0.0) -> np.ndarray:
        """Sum of table values over each unit's weighted subsequences, divided by its norm."""
        out = np.full(self.n, empty)
        for rows, codes in self.groups:
            size = codes.shape[1]
            for a in range(0, len(rows), 200_000):
                part = codes[a : a + 200_000]
                total, norm = np.zeros(len(part), "float32"), 0.0
                for i, j in _OFFSETS:
                    if (n := size - j) > 0:
                        weight = DECAY ** (j + 1)
                        norm += n * weight * weight
                        index = (part[:, :n] * _LETTERS + part[:, i : i + n]) * _LETTERS + part[:, j:]
                        total += weight * table[index].sum(axis=1)
                out[rows[a : a + 200_000]] = total / np.sqrt(norm)
        return out

    def table(self) -> np.ndarray:
        """Each unit's subsequences as a row of weights, divided by its norm."""
        out = np.zeros((self.n, _LETTERS**3), "float32")
        for rows, codes in self.groups:
            size, norm = codes.shape[1], 0.0
            for i, j in _OFFSETS:
                if (n := size - j) > 0:
                    weight = DECAY ** (j + 1)
                    norm += n * weight * weight
                    index = (codes[:, :n] * _LETTERS + codes[:, i : i + n]) * _LETTERS + codes[:, j:]
                    np.add.at(out, (np.repeat(rows, n), index.ravel()), weight)
            out[rows] /= np.sqrt(norm)
        return out


@dataclass
class ToxicityModel:
    table: np.ndarray
    bias: float
    slope: float
    level: float
    prior: float | None = None  # the score of every text if only one class was seen

    def text_values(self, texts: pa.Array) -> np.ndarray:
        codes, units, counts = units_of(texts)
        return _best(self.unit_values(units), codes, counts)

    def unit_values(self, units: list[str]) -> np.ndarray:
        return Units(units).values(self.table, empty=_NONE - self.bias) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-(self.slope * self.text_values(texts) + self.level)))


def _best(values: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.full(len(counts), _NONE)
    if some := np.flatnonzero(counts).tolist():
        out[some] = np.maximum.reduceat(values[codes], (np.cumsum(counts) - counts)[some])
    return out


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of docs (doc_id, text) that have a label (doc_id, toxic).

    A bounded sample is fetched: TRAIN_DOCS documents of each class, the first by the
    hash of their id. A text with both labels counts as toxic. Null texts and labels are left out. With one class, or no
    row, the model gives that class's score, or 0, to every text.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.join(docs.filter("text is not null").select("doc_id"), "doc_id", "left_semi")
    first = [marked.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for c in (0, 1)]
    sample = F.broadcast(first[0].unionByName(first[1]))  # at most 2 TRAIN_DOCS ids
    rows = docs.select("doc_id", "text").filter("text is not null").join(sample, "doc_id").select("text", "toxic").collect()
    toxic = sorted({r["text"] for r in rows if r["toxic"]})
    clean = sorted({r["text"] for r in rows if not r["toxic"]} - set(toxic))
    if not clean or not toxic:
        return ToxicityModel(np.zeros(1, "float32"), 0.0, 1.0, 0.0, prior=float(bool(toxic)))
    model = fit(toxic, clean)
    pa.default_memory_pool().release_unused()  # the driver goes on with other work
    return model


def fit(toxic: list[str], clean: list[str]) -> ToxicityModel:
    """The model of sentences of toxic and clean texts; the same for the same lists."""
    t_codes, t_units, t_counts = units_of(pa.array(toxic, "string"))
    c_codes, c_units, c_counts = units_of(pa.array(clean, "string"))
    in_toxic, in_clean = (_texts_with(*x) for x in ((t_codes, t_units, t_counts), (c_codes, c_units, c_counts)))
    odds = _first_odds(t_units, in_toxic, in_clean, len(toxic), len(clean))
    clean_units = sorted(in_clean, key=lambda u: (hash_of(u), u))
    all_clean = Units(clean_units)
    negative = set(clean_units[:CLEAN_UNITS])
    values = odds
    model = ToxicityModel(np.zeros(_LETTERS**3, "float32"), 0.0, 1.0, 0.0)
    for _ in range(ROUNDS):
        named = Counter(u for u in _named(values, t_codes, t_units, t_counts) if u not in in_clean or in_toxic[u] > 4 * in_clean[u])
        if not named:
            break
        positive = [u for u, _ in sorted(named.items(), key=lambda x: (-x[1], x[0]))]
        model.table, model.bias = _machine(positive, np.array([named[u] for u in positive], float), sorted(negative - set(positive)))
        wrong = all_clean.values(model.table, empty=_NONE) + model.bias
        negative.update(clean_units[i] for i in np.argsort(-wrong, kind="stable")[:HARD_UNITS] if wrong[i] > -1.0)
        values = model.unit_values(t_units) + 0.1 * np.clip(odds, -5, 5)
    own = [_best(model.unit_values(u), c, n) for c, u, n in ((t_codes, t_units, t_counts), (c_codes, c_units, c_counts))]
    model.slope, model.level = _logistic(np.concatenate(own), np.repeat([1.0, 0.0], [len(toxic), len(clean)]))
    return model


def _first_odds(units: list[str], in_toxic: Counter[str], in_clean: Counter[str], n_toxic: int, n_clean: int) -> np.ndarray:
    """How telling a unit is at first: the largest log odds of its stretches of GRAM letters."""
    grams: tuple[Counter[str], Counter[str]] = Counter(), Counter()  # of the clean, only those of the toxic
    for own, counts in zip(grams, (in_toxic, in_clean), strict=True):
        for unit, n in counts.items():
            for g in {unit[i : i + GRAM] for i in range(len(unit) - GRAM + 1)}:
                if own is grams[0] or g in grams[0]:
                    own[g] += n
    value = {g: np.log((n + 0.5) / (grams[1][g] * n_toxic / n_clean + 0.5)) for g, n in grams[0].items()}
    return np.array([max((value.get(u[i : i + GRAM], -9.0) for i in range(len(u) - GRAM + 1)), default=-9.0) for u in units])


def hash_of(unit: str) -> int:
    return int.from_bytes(unit.encode("utf-8", "surrogatepass")[-8:].rjust(8), "little") * 0x9E3779B97F4A7C15 % (1 << 61)


def _texts_with(codes: np.ndarray, units: list[str], counts: np.ndarray) -> Counter[str]:
    pairs = np.unique(np.repeat(np.arange(len(counts)), counts) * len(units) + codes)
    n = np.bincount(pairs % max(1, len(units)), minlength=len(units))
    return Counter({u: int(k) for u, k in zip(units, n, strict=True) if k})


def _named(values: np.ndarray, codes: np.ndarray, units: list[str], counts: np.ndarray) -> Iterable[str]:
    """Each text's unit of the largest value, the first of equals."""
    for part in np.split(codes, np.cumsum(counts)[:-1]):
        if len(part):
            yield units[part[np.argmax(values[part])]]


def _machine(positive: list[str], weight: np.ndarray, negative: list[str]) -> tuple[np.ndarray, float]:
    """Value per subsequence and bias of a linear machine on Nystroem features."""
    step = max(1, len(negative) // (LANDMARKS // 3))
    landmarks = [*positive[: LANDMARKS - LANDMARKS // 3], *negative[::step][: LANDMARKS // 3]]
    bases = Units(landmarks).table()
    units = Units(positive + negative)
    values, vectors = np.linalg.eigh(bases @ bases.T + 1e-4 * np.eye(len(bases)))
    root = vectors / np.sqrt(np.maximum(values, 1e-4)) @ vectors.T
    x = np.ones((units.n, len(bases) + 1))
    for i, b in enumerate(bases):
        x[:, i] = units.values(b)
    x[:, :-1] = x[:, :-1] @ root
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    share = np.concatenate([np.minimum(weight, 20) / np.minimum(weight, 20).sum(), np.full(len(negative), 30 / max(1, len(negative)))])
    w = np.zeros(x.shape[1])
    ridge = SOFTNESS * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    for _ in range(25):
        active = np.flatnonzero(y * (x @ w) < 1)
        bend, pull = ridge.copy(), np.zeros(len(w))
        for part in np.split(active, range(SOLVED_ROWS, len(active), SOLVED_ROWS)):
            a = x[part] * share[part, None]
            bend += a.T @ x[part]
            pull += a.T @ y[part]
        new = np.linalg.solve(bend, pull)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return (root @ w[:-1] @ bases).astype("float32"), float(w[-1])


def _logistic(values: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic curve."""
    x = np.stack([values, np.ones(len(values))], 1)
    share = np.full(len(label), 1 / len(label))
    w = np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (label - p)) - 1e-4 * w * [1, 0]
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag([1e-4, 1e-6])
        w = w + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def scored(docs: DataFrame, model: ToxicityModel, into: str = "score") -> DataFrame:
    """`docs` (with a column text) with score, from 0 to 1, in the column `into`. Null and empty texts have the lowest value a text can have."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [held.value.scores(texts[a:b]) for a, b in text_chunks(texts)]
        return pa.array(np.concatenate(parts) if parts else [], "double")

    return docs.withColumn(into, score("text"))
