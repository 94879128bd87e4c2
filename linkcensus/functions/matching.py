"""Does a text field contain any term of a watch-list?

Terms are lower-case, fields are compared in lower case.

* few terms: JVM expressions only. The field is lower-cased once per row, and terms
  with a common beginning share a cheap test for that beginning, so that a list of
  URLs of one host costs about as much as a single ``contains``.
* more terms, as many as one regular expression takes: that expression over whole Arrow batches.
* more than that, or with wildcards: one pass of ``multipattern`` over Arrow batches, whatever their number.
* in all these a test for characters all terms share, ``://`` in a list of URLs,
  comes first and spares most fields everything else.
* lists beyond one task's memory: covered terms are removed as a table, and if that is
  not enough, ``operators.blocked`` joins texts and terms.
"""

import os
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcensus.functions.multipattern import Matcher, like_regex, quoted, segments
from linkcensus.operators.blocked import keep_containing
from linkcensus.operators.covering import without_covered_terms
from linkcensus.operators.staging import Staging

JVM_TERMS = 64          # more terms than this are matched in Arrow batches
JVM_PROBES = 4          # so are lists with more separate beginnings than this
REGEX_TERMS = 400       # a regular expression takes so many terms, to stay within its automaton's memory
REGEX_CHARS = 32_000
TASK_CHARS = 1_000_000  # characters of terms that every task holds
_MEAN_CHARS = 20        # so a list of up to TASK_CHARS / _MEAN_CHARS terms is read in one go
_SHARED = 8             # terms alike in this many characters are tested together


class Terms:
    """Match terms one task can hold: literals, and LIKE patterns if wanted."""

    def __init__(self, terms: list[str], wildcards: bool = False):
        wild = [t for t in terms if wildcards and re.search("[%_]", t)]
        self.patterns = sorted(set(wild))
        self.literals = without_covered(list(set(terms) - set(wild)))


def without_covered(terms: list[str]) -> list[str]:
    """Drop every term that holds a shorter one: the shorter one finds it all.

    Takes a lookup per character, for lists of any length: where no term begins
    another, the one that begins a given text can only be the last not after it.
    """
    free: list[str] = []
    for term in sorted(set(terms)):
        if not free or not term.startswith(free[-1]):
            free.append(term)

    def covered(term: str) -> bool:
        tails = (term[i:] for i in range(1, len(term)))
        return any(at and tail.startswith(free[at - 1]) for tail in tails for at in [bisect_right(free, tail)])

    return sorted((t for t in free if not covered(t)), key=lambda t: (len(t), t))


class WatchList:
    """A list of match terms, of any size.

    ``mode="instr"`` takes every character literally; ``mode="like"`` reads ``%``
    and ``_`` inside a term as wildcards (a backslash stays a plain character).
    """

    def __init__(self, terms: DataFrame, mode: str, task_chars: int = TASK_CHARS):
        if mode not in ("like", "instr"):
            raise ValueError(f"unknown match mode {mode!r}")
        self.table = terms.select("match_term").filter("match_term IS NOT NULL")
        self.wildcards = mode == "like"
        self._task_chars = task_chars
        self._terms = self._read(self.table)
        self._reduced = False

    def _read(self, table: DataFrame) -> Terms | None:
        """The terms, if they are within what a task may hold; no more of them than that comes to the driver."""
        most = self._task_chars // _MEAN_CHARS
        start = [r.match_term for r in table.limit(most + 1).collect()]
        if len(start) <= most and sum(map(len, start)) <= self._task_chars:
            return Terms(start, self.wildcards)
        return None

    def terms(self, staging: Staging) -> Terms | None:
        """The terms, or None if they stay a table, from which terms that hold others have been removed."""
        if self._terms is None and not self._reduced:
            self.table = staging.write(without_covered_terms(self.table, self.wildcards, staging))
            self._terms = self._read(self.table)
            self._reduced = True
        return self._terms


def contains_any(terms: Terms, *columns: str) -> Column:
    """True where one of ``columns`` contains one of ``terms``."""
    return reduce(or_, [_contains_any(terms, c) for c in columns])


def keep_matching(
    df: DataFrame, watch: WatchList, *columns: str, staging: Staging, keep: Sequence[str] | None = None
) -> DataFrame:
    """Columns ``keep`` (all, if not given) of the rows that mention the watch-list, each as often as ``df`` has it."""
    terms = watch.terms(staging)
    keep = df.columns if keep is None else keep
    if terms is not None:
        return df.filter(contains_any(terms, *columns)).select(*keep)
    return keep_containing(df, columns, keep, watch.table, watch.wildcards, staging)


def _contains_any(terms: Terms, column: str) -> Column:
    groups = _by_beginning(terms.literals)
    if not groups and not terms.patterns:
        return F.lit(False)
    n = len(terms.literals) + len(terms.patterns)
    if n <= JVM_TERMS and len(groups) + len(terms.patterns) <= JVM_PROBES:
        found = _by_expression(terms, groups, column)
    elif not terms.patterns and n <= REGEX_TERMS and sum(map(len, terms.literals)) <= REGEX_CHARS:
        found = _by_regex(terms.literals, column)
    else:
        found = _by_matcher(terms, column)
    piece = None if terms.patterns else _caseless_piece(terms.literals)
    return F.col(column).contains(piece) & found if piece else found


def _caseless_piece(literals: list[str]) -> str | None:
    """Three or more ASCII characters without case that all terms share, if any.

    Lower-casing neither changes nor creates such characters, so a field without the
    piece (``://`` for a list of URLs) is ruled out as it is, before anything else.
    """
    runs = re.findall(r"[\x00-@\[-`{-\x7f]{3,64}", min(literals, key=len))
    pieces = {run[i:j] for run in runs for i in range(len(run)) for j in range(i + 3, len(run) + 1)}
    shared = [p for p in pieces if all(p in t for t in literals)]
    return max(shared, key=lambda p: (len(p), p), default=None)


def _by_expression(terms: Terms, groups: list[list[str]], column: str) -> Column:
    def test(text: Column) -> Column:
        probes = [_probe(text, g) for g in groups]
        probes += [_pattern_probe(text, p) for p in terms.patterns]
        return reduce(or_, probes)

    # A one-element array binds the lower-cased text, so it is computed only once;
    # as bytes, because that is the faster form of contains.
    return F.exists(F.array(F.lower(column).cast("binary")), test)


def _pattern_probe(text: Column, pattern: str) -> Column:
    """Test for a LIKE pattern, behind its longest literal segment."""
    fits = text.cast("string").rlike(like_regex(pattern))
    segment = max(segments(pattern), key=len, default=None)
    return fits if segment is None else text.contains(F.lit(segment.encode())) & fits


def _by_regex(literals: list[str], column: str) -> Column:
    """ASCII literals are found in the text as it is; the rest in its lower case."""
    ascii_only = [t for t in literals if t.isascii()]
    rest = [quoted(t) for t in literals if not t.isascii()]
    found = []
    if ascii_only:
        found.append(_in_batches([_any_case(t) for t in ascii_only])(column))
    if rest:
        found.append(_in_batches(rest)(F.lower(column)))
    return reduce(or_, found)


def _by_matcher(terms: Terms, column: str) -> Column:
    """One pass for all; only characters beyond ASCII need the JVM's lower case."""
    matcher = Matcher(terms.literals, terms.patterns)
    plain = all(t.isascii() for t in terms.literals) and all(p.isascii() for p in terms.patterns)

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(matcher.found(texts))

    return F.arrow_udf(scan, "boolean")(F.col(column) if plain else F.lower(column))


def _by_beginning(literals: list[str]) -> list[list[str]]:
    groups: dict[str, list[str]] = {}
    for term in literals:
        groups.setdefault(term[:_SHARED], []).append(term)
    return list(groups.values())


def _probe(text: Column, group: list[str]) -> Column:
    """Test a group of terms behind the beginning they share."""
    shared = os.path.commonprefix(group)
    found = text.contains(F.lit(shared.encode()))
    if len(group) == 1:
        return found
    branches: dict[str, list[str]] = {}
    for term in group:
        branches.setdefault(term[: len(shared) + 1], []).append(term)
    return found & reduce(or_, [_probe(text, b) for b in branches.values()])


def _any_case(term: str) -> str:
    """Expression that finds in a text what an ASCII ``term`` finds in its lower case.

    Besides A-Z two characters have ASCII in their lower case: the Kelvin sign gives
    k, and the dotted capital I gives an i with a combining dot, which no further
    ASCII character can follow.
    """
    letters = {c: f"[{c}{c.upper()}]" for c in "abcdefghijklmnopqrstuvwxyz"} | {"k": "[kK\u212a]"}
    out = [letters.get(c) or quoted(c) for c in term]
    if term.endswith("i"):
        out[-1] = "[iI\u0130]"
    return "".join(out)


def _in_batches(parts: list[str]) -> Callable[[Column], Column]:
    """Arrow UDF: does one of the expressions match somewhere?"""
    regex = "(?s)" + "|".join(parts)

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pc.match_substring_regex(texts, pattern=regex)

    return F.arrow_udf(scan, "boolean")
