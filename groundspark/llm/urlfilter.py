"""URL rules by a sort-merge range join.

A page's canonical key is its host's labels in reverse, each with a dot behind it, so a rule's host and all its subdomains
are one interval of keys, and intervals are nested or apart. Pages and rules are dealt into ranges of keys (a rule goes to
each range that its interval meets), sorted by key and swept once with a stack of the hosts whose intervals are open. Each host
on the stack has its path rules in order, every one pointing at the rule that encloses it, so the longest path that fits
is found by bisection. Range bounds come from a sample of the pages' keys; they only balance the work.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.batches import column

#: Pages in a range, about; ranges at most; keys sampled for each range and how much of a key a bound holds.
RANGE_ROWS = 10_000
MAX_RANGES = 4096
SAMPLE = 32
BOUND_CHARS = 200
#: Sorts after every character that a key may hold.
LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class OpenHost:
    """A rule host with its paths in rising order."""

    def __init__(self, key: str, host: str) -> None:
        self.key, self.host = key, host
        self.paths: list[str] = []
        self.verdicts: list[str] = []
        self.outer: list[int] = []  # the rule that encloses each, -1 for none

    def _fitting(self, at: int, path: str) -> int:
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return at

    def add(self, path: str, verdict: str) -> None:
        self.outer.append(self._fitting(len(self.paths) - 1, path))
        self.paths.append(path)
        self.verdicts.append(verdict)

    def longest(self, path: str) -> int:
        """Number of the longest rule that ``path`` starts with, -1 without one."""
        return self._fitting(bisect_right(self.paths, path) - 1, path)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (range, key), rules first and by path: each page with the longest rule that fits."""
    stack: list[OpenHost] = []
    now = None
    for batch in batches:
        pages, rules, verdicts = [], [], []
        cols = [column(batch, c).to_pylist() for c in ("range", "key", "host", "path", "verdict")]
        for i, (part, key, host, path, verdict) in enumerate(zip(*cols, strict=True)):
            if part != now:
                stack, now = [], part
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if verdict is not None:
                if not stack or stack[-1].key != key:
                    stack.append(OpenHost(key, host))
                stack[-1].add(path, verdict)
                continue
            best, rule, what = (-1, -1), None, None
            for opened in stack:
                at = opened.longest(path)
                if at >= 0 and (size := (len(opened.host) + len(opened.paths[at]), len(opened.host))) > best:
                    best, rule, what = size, opened.host + opened.paths[at], opened.verdicts[at]
            pages.append(i)
            rules.append(rule)
            verdicts.append(what)
        kept = batch.take(pa.array(pages, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [column(kept, "id"), column(kept, "host"), column(kept, "path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"]
        )


def _dealer(bounds: list[str]):
    """Adds the range of a page, or a row for each range that a rule's interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ranges = [], []
            for i, (place, verdict) in enumerate(zip(column(batch, "place").to_pylist(), column(batch, "verdict").to_pylist(), strict=True)):
                first = bisect_right(bounds, place)
                last = first if verdict is None else bisect_right(bounds, place + LAST)
                rows += [i] * (last - first + 1)
                ranges += range(first, last + 1)
            dealt = batch.take(pa.array(rows, pa.int64())).drop_columns(["place"])
            yield dealt.append_column("range", pa.array(ranges, pa.int32()))

    return run


def judge(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES
) -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains where the
    path starts with its path; the longest (host and path together, then host) wins, and of
    rules equal in both a ``block`` does. Pages that no rule fits have a null rule and the ``default``
    verdict. A null url, or one without ``://``, has an empty host and path. Rules with a null host,
    path or verdict are left out. Repeated rows all get a row; with no pages there is none. Pages of one host are
    spread over ranges by path and a hash of id and url.
    """
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = rules.where("host is not null and path is not null and verdict is not null").select(lower.alias("host"), "path", "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", key_of(F.col("host")))
    parsed = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.xxhash64(id_col, url_col).alias("mix")).withColumn("key", key_of(F.col("host")))
    place = F.concat(F.substring(F.concat("key", "path"), 1, BOUND_CHARS), F.lit("\x00"), F.lpad(F.hex("mix"), 16, "0"))
    ranges = max(1, min(max_ranges, -(-pages.count() // range_rows)))
    sample = parsed.select(place.alias("place"), "mix").orderBy("mix").limit(SAMPLE * ranges).select("place").collect() if ranges > 1 else []
    drawn = sorted(r["place"] for r in sample)
    deal = _dealer([drawn[k * len(drawn) // ranges] for k in range(1, ranges)] if drawn else [])

    id_type = pages.schema[id_col].dataType.simpleString()
    fields = f"id {id_type}, key string, host string, path string, verdict string"
    points = parsed.select("id", "key", "host", "path", F.lit(None).cast("string").alias("verdict"), place.alias("place"))
    openings = rules.select(F.lit(None).cast(id_type).alias("id"), "key", "host", "path", "verdict", F.substring("key", 1, BOUND_CHARS).alias("place"))
    dealt = openings.unionByName(points).mapInArrow(deal, f"{fields}, range int")
    swept = (
        dealt.repartitionById(ranges, F.col("range"))
        .sortWithinPartitions("range", "key", F.col("verdict").isNull(), "path")
        .mapInArrow(_sweep, f"id {id_type}, host string, path string, rule string, verdict string")
    )
    return swept.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
