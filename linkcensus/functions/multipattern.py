"""Many terms at once: which texts of an Arrow array contain one of them?

Every term is found by an anchor, a window of 1, 2, 3, 4 or 8 of its bytes, the rarest
one in the whole list. One pass over the bytes of a batch looks all windows up in a table of
bits; the few that pass are searched among the sorted anchors, and then the rest of
the term is compared, eight bytes at a time for all candidates together. The cost
of the pass does not depend on the number of terms, only the size of the table does.

A LIKE pattern is found by its longest literal segment; only the texts that hold it
are tested against the whole pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18  # bytes looked up at a time, so that arrays stay in the processor's cache
PAIRS = 1 << 21  # candidates compared at a time
_ODD, _ODD_TOO = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
# Characters besides A-Z with ASCII in their lower case, and that lower case.
_SIGNS = {"\u212a": "k", "\u0130": "i\u0307"}
_WIDTHS = (1, 2, 3, 4, 8)
_SPARE = 11  # bytes after the last, so that every byte begins a window and its block


def segments(pattern: str) -> list[str]:
    """The literal parts of a LIKE pattern, in which a backslash is a plain character."""
    return [s for s in re.split("[%_]+", pattern) if s]


def quoted(text: str) -> str:
    """A literal as a regular expression of Java, Python and RE2."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def like_regex(pattern: str) -> str:
    """Regular expression of Java and Python that finds what LIKE finds with ``%`` at both ends.

    What stands between two ``%`` has a fixed length, so the leftmost places will do: atomic
    groups keep the search from going back.
    """
    parts = [p for p in pattern.split("%") if p]
    return r"(?s)\A" + "".join("(?>.*?" + "".join("." if c == "_" else quoted(c) for c in p) + ")" for p in parts)


def lower_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one row with A-Z in lower case, and where each begins and the last ends; null is empty.

    Besides A-Z two characters have ASCII in their lower case, the Kelvin sign and the dotted
    capital I; they are replaced by it. So ASCII terms are found as in the lower-cased texts.
    """
    texts = texts.cast(pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if _holds_signs(texts):
        for sign, lower in _SIGNS.items():
            texts = pc.replace_substring(texts, sign, lower)
    offsets = np.frombuffer(texts.buffers()[1] or bytes(4), "int32")[texts.offset : texts.offset + len(texts) + 1].astype("int64")
    out = np.zeros(offsets[-1] - offsets[0] + _SPARE, "uint8")
    if len(out) > _SPARE:
        data = np.frombuffer(texts.buffers()[2], "uint8")[offsets[0] : offsets[-1]]
        np.add(data, (data - np.uint8(65) < 26).view("uint8") << np.uint8(5), out=out[:-_SPARE])
    return out, offsets - offsets[0]


def _holds_signs(texts: pa.Array) -> bool:
    data = np.frombuffer(texts.buffers()[2] or b"", "uint8")
    for low in range(0, len(data), BLOCK):
        block = data[low : low + BLOCK + 2]
        for sign in map(str.encode, _SIGNS):
            at = np.flatnonzero(block[: max(0, len(block) - len(sign) + 1)] == sign[0]) if sign[0] in block else np.empty(0, "int64")
            for i, byte in enumerate(sign[1:], 1):
                at = at[block[at + i] == byte]
            if len(at):
                return True
    return False


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as an integer; the data end with some spare bytes."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def _hashes(low: np.ndarray, high: np.ndarray | None) -> np.ndarray:
    """32-bit hashes of windows, from their first and last four bytes; no last ones stands for zeros."""
    return low * _ODD if high is None else low * _ODD + high * _ODD_TOO


def _masked(words: np.ndarray, width: int) -> np.ndarray:
    return words & np.uint64((1 << 8 * width) - 1) if width < 8 else words


class _Anchors:
    """The terms of one window width."""

    def __init__(self, width: int, terms: np.ndarray, words: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.width = width
        n = size[terms] - width + 1
        owner = np.repeat(np.arange(len(terms)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        value = _masked(words[start[terms][owner] + offset], width)
        _, code, count = np.unique(value, return_inverse=True, return_counts=True)
        best = np.lexsort((-offset, count[code], owner))[np.cumsum(n) - n]  # the rarest of each term, the last of those
        order = np.argsort(value[best], kind="stable")
        self.terms, self.offset = terms[order], offset[best][order]
        self.values, self.many = np.unique(value[best], return_counts=True)
        self.first = np.cumsum(self.many) - self.many
        bits = min(22, max(14, len(self.values).bit_length() + 5))
        self.shift = np.uint32(32 - bits)
        self.table = np.zeros(1 << bits, "bool")
        self.table[_hashes(self.values.astype("uint32"), (self.values >> np.uint64(32)).astype("uint32")) >> self.shift] = True

    def candidates(self, words: np.ndarray, low: int, four: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where terms may begin whose anchors are in a block, and which. four: from each byte of the block on, four bytes, and eight more."""
        if self.width == 8:
            hashes = _hashes(four[:-8], four[4:-4])
        else:
            hashes = _hashes(four[:-8] if self.width == 4 else four[:-8] & np.uint32((1 << 8 * self.width) - 1), None)
        at = np.flatnonzero(self.table[(hashes >> self.shift).astype("int64")])
        value = _masked(words[at + low], self.width)
        group = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
        known = self.values[group] == value
        at, group = at[known] + low, group[known]
        many = self.many[group]
        upto = np.cumsum(many)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            n = many[a:b]
            member = np.repeat(self.first[group[a:b]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(at[a:b], n) - self.offset[member], self.terms[member]
            a = b


class Matcher:
    """Literal terms and LIKE patterns, all in lower case."""

    def __init__(self, literals: Iterable[str], patterns: Iterable[str] = ()):
        literals, patterns = list(literals), list(patterns)
        self.patterns = [p for p in patterns if segments(p)]
        bare = [p.count("_") for p in patterns if not segments(p)] + [0 for t in literals if not t]
        #: A pattern of wildcards alone holds wherever a text has so many characters, an empty term everywhere.
        self.least_chars = min(bare, default=None)
        literals = [t for t in literals if t]
        anchors = literals + [max(segments(p), key=lambda s: len(s.encode())) for p in self.patterns]
        coded = [a.encode() for a in anchors]
        self.literals = len(literals)
        self.size = np.array([len(c) for c in coded], dtype="int64")
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(coded) + bytes(_SPARE), "uint8")

    @cached_property
    def _anchors(self) -> list[_Anchors]:
        """Made where it is used: only the terms themselves travel."""
        width = np.array(_WIDTHS)[np.searchsorted(_WIDTHS, self.size, "right") - 1] if len(self.size) else np.empty(0, "int64")
        words = _words(self.data)
        return [_Anchors(w, np.flatnonzero(width == w), words, self.start, self.size) for w in _WIDTHS if (width == w).any()]

    @cached_property
    def _tests(self) -> list[re.Pattern]:
        return [re.compile(like_regex(p)) for p in self.patterns]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_anchors", "_tests")}

    def found(self, texts: pa.Array) -> np.ndarray:
        """True for each text that contains a term or fits a pattern; a null text contains nothing."""
        out = np.zeros(len(texts), "bool")
        data, offsets = lower_bytes(texts)
        begin, end = offsets[:-1], offsets[1:]
        words, own = _words(data), _words(self.data)
        perhaps: set[tuple[int, int]] = set()
        for low in range(0, int(offsets[-1]), BLOCK):
            block = data[low : low + BLOCK + 11].astype("uint32")
            two = block[:-1] | block[1:] << np.uint32(8)
            four = two[:-2] | two[2:] << np.uint32(16)
            for anchors in self._anchors:
                for at, term in anchors.candidates(words, low, four):
                    text = np.searchsorted(end, at, "right")  # the text that `at`, if it is in any, lies in
                    text = np.minimum(text, len(end) - 1)
                    inside = (at >= begin[text]) & (at + self.size[term] <= end[text]) & (~out[text] | (term >= self.literals))
                    at, term, text = at[inside], term[inside], text[inside]
                    done = 0
                    while len(at):
                        left = self.size[term] - done
                        bits = (8 * np.minimum(left, 8)).astype("uint64")
                        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - bits)
                        same = (words[at + done] ^ own[self.start[term] + done]) & mask == 0
                        whole = same & (left <= 8)
                        literal = whole & (term < self.literals)
                        out[text[literal]] = True
                        perhaps.update(zip(text[whole & ~literal].tolist(), (term[whole & ~literal] - self.literals).tolist(), strict=True))
                        goes_on = same & ~whole
                        at, term, text = at[goes_on], term[goes_on], text[goes_on]
                        done += 8
        decoded: dict[int, str] = {}
        for text, pattern in perhaps:
            if not out[text]:
                if text not in decoded:
                    decoded[text] = data[begin[text] : end[text]].tobytes().decode()
                out[text] = bool(self._tests[pattern].search(decoded[text]))
        if self.least_chars is not None:
            upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters, not bytes
            out |= (upto[end] - upto[begin] >= self.least_chars) & texts.is_valid().to_numpy(zero_copy_only=False)
        return out
