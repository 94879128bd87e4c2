"""URL filters over dated lists, in DataFrame operations only.

Dated list entries (a pattern is added to or removed from a list on a day) become
validity intervals, and every capture is judged by the entries active when it was
fetched. A pattern is a host suffix (`example.org`) or a host with leading path
segments (`www.example.org/a/b`). A capture's own host suffixes and path prefixes are
looked up by equality; no list is scanned per capture.

Intervals are cut at the ends of periods of PERIOD_DAYS days, so that the join is on
(pattern, period) and a host with many entries or a third of all captures spreads over
periods; the join's exchanges are plain, so that adaptive execution can split what is
left. Path prefixes are looked up only as deep as the deepest pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD_DAYS = 16


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to) from entries (list, pattern, day date, seq long, added boolean).

    Of several entries for a pattern on a day the one with the largest seq counts; on
    equal seq, an addition. valid_to is exclusive, null for ever. Patterns are trimmed
    and lower-cased. Rows with a null or empty pattern, null list or null day are void.
    """
    pattern = F.lower(F.trim("pattern"))
    entries = entries.select("list", pattern.alias("pattern"), "day", "seq", F.coalesce("added", F.lit(False)).alias("added"))
    entries = entries.filter("list is not null and pattern <> '' and day is not null")
    daily = entries.groupBy("list", "pattern", "day").agg(F.max(F.struct("seq", "added"))["added"].alias("added"))
    by_day = Window.partitionBy("list", "pattern").orderBy("day")
    changes = daily.withColumn("_was", F.lag("added", 1, False).over(by_day)).filter("added <> _was")
    spans = changes.withColumn("valid_to", F.lead("day").over(by_day))
    return spans.filter("added").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def url_host(url: Column) -> Column:
    """Host of a URL with scheme, in lower case, without user, port and last dot; empty if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"\.+$", "")


def url_path(url: Column) -> Column:
    """Path segments of a URL in lower case, joined by single slashes, without slash at the ends."""
    path = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")


def judged(captures: DataFrame, intervals: DataFrame, lists: tuple[str, str] = ("block", "allow")) -> DataFrame:
    """(capture_id, fetched_on, n_active, decided_by, blocked) of captures (capture_id, url, fetched_on).

    n_active: entries active for the capture on its day. decided_by: the longest active
    pattern, of equally long ones the smallest. blocked: that pattern is on the
    first list and not also on the second. Captures with a null or host-less URL or a
    null day match nothing and are not blocked. Captures of one id, URL and day count
    once. With no intervals nothing is blocked; with no captures the result is empty.
    """
    block, allow = lists
    captures = captures.select("capture_id", "url", "fetched_on").distinct()
    depth = intervals.agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0))).scalar()
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    names = captures.withColumns({"_host": host, "_segments": F.split(path, "/"), "_labels": F.split(host, r"\.")})
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size("_labels")), lambda i: F.array_join(F.slice("_labels", i, F.size("_labels")), ".")
    )
    names = names.withColumn("_deepest", F.least(F.size("_segments"), depth))
    deepest = F.col("_deepest")
    prefixes = F.transform(
        F.when(deepest > 0, F.sequence(F.lit(1), deepest)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.col("_host"), F.lit("/"), F.array_join(F.slice("_segments", 1, i), "/")),
    )
    patterns = F.when(F.col("_host") != "", F.array_distinct(F.concat(suffixes, prefixes)))
    looked_up = names.select(
        "capture_id", "url", "fetched_on", _period(F.col("fetched_on")).alias("_period"), F.explode_outer(patterns).alias("pattern")
    )
    # An interval is cut into the periods that have a capture, however far apart these are.
    periods = captures.agg(F.collect_set(_period(F.col("fetched_on")))).scalar()
    first, last = _period(F.col("valid_from")), _period(F.date_sub("valid_to", 1))
    cut = intervals.withColumn("_periods", periods).select(
        "list",
        "pattern",
        "valid_from",
        "valid_to",
        F.explode(F.filter("_periods", lambda p: (p >= first) & (last.isNull() | (p <= last)))).alias("_period"),
    )
    active = (F.col("valid_from") <= F.col("fetched_on")) & (
        F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))
    )
    found = looked_up.join(cut, ["pattern", "_period"], "left")
    hit = F.when(active, F.struct(-F.length("pattern"), F.col("pattern"), F.col("list") != allow, "list"))
    best = F.min(F.when(F.col("list").isin(block, allow), hit))
    verdicts = found.groupBy("capture_id", "url", "fetched_on").agg(F.count(hit).alias("n_active"), best.alias("_best"))
    return verdicts.select(
        "capture_id",
        "fetched_on",
        "n_active",
        F.col("_best.pattern").alias("decided_by"),
        F.coalesce(F.col("_best.list") == block, F.lit(False)).alias("blocked"),
    )


def _period(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / PERIOD_DAYS).cast("int")
