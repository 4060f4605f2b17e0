"""URL filters: a sort-merge range join of urls with (host, path) rules.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; its path
goes from there up to ``?``, ``#`` or the end. NULL and text without ``://`` have an empty host and path. A rule
fits its host and all subdomains of it if the path starts with the rule's path.

Keys: a host read backwards with a closing dot (``ten.elpmaxe.``) is the prefix of the keys of all its subdomains,
so a rule is one interval of keys and two intervals are nested or apart. Cut points taken from a bounded sample of
the urls deal keys, paths and rows of one url out over the tasks; a rule goes to every task that its interval
meets. Each task holds its urls and rules in the order of the keys and sweeps over them once with a stack of the
rules whose interval is open; of the stack's rules whose path fits, the longest wins.

Cuts only balance the tasks: any cut points give the same result. The last part of a cut is a hash of the input
partition, so a host, a url or a fully equal row that holds a third of all rows is spread as well.

Results: one row per input row, ``row`` (the input columns, whatever their names), host, path, rule (host and path of
the winner, NULL if none fits) and verdict (the winner's, else ``default``). The longest rule has the longest host,
then the longest path; of equal rules the one whose verdict comes last in the alphabet (block before allow). Rules:
a NULL host or path counts as empty, an empty host fits every url, A-Z in hosts are lower-cased, a rule without a
verdict is left out. Empty tables give no rows, or ``default`` for all.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from staywise.llm.common import ship

SAMPLE = 20  # sampled urls per cut point; balance only
CUTS = 20_000  # cut points at most, so that cuts and their sample stay below some MB on the driver
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    """The host read backwards, closed by a dot; empty for the empty host of a rule that fits all."""
    return F.concat(F.reverse(host), F.lit("."))


def _rows(df: DataFrame, url: str) -> DataFrame:
    host, path = url_parts(F.col(url).cast("string"))
    rows = df.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    return rows.select("row", "host", "path", F.xxhash64(F.spark_partition_id()).alias("salt"), host_key(F.col("host")).alias("key"))


def _cut_points(rows: DataFrame, parts: int) -> list[tuple[str, str, int]]:
    """At most ``CUTS`` (key, path, salt) from a sample of ``SAMPLE`` urls for each."""
    parts = min(parts, CUTS)
    total = rows.count()
    if parts < 2 or not total:
        return []
    share = min(1.0, 1.5 * SAMPLE * parts / total)
    drawn = rows.select("key", "path", "salt").sample(share, seed=1).limit(2 * SAMPLE * parts).collect()
    drawn = sorted(tuple(r) for r in drawn)
    return sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []


def _deal(batches: Iterator[pa.RecordBatch], cuts: list[tuple[str, str, int]]) -> Iterator[pa.RecordBatch]:
    """Add the slot of each url."""
    for batch in batches:
        places = zip(*(batch.column(c).to_pylist() for c in ("key", "path", "salt")))
        slots = pa.array([bisect_right(cuts, p) for p in places], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, slots], names=[*batch.schema.names, "slot"])


def _spread(batches: Iterator[pa.RecordBatch], cuts: list[tuple[str, str, int]]) -> Iterator[pa.RecordBatch]:
    """Each rule once for every slot that its interval of keys meets."""
    for batch in batches:
        keys = batch.column("key").to_pylist()
        least = [bisect_left(cuts, (k,)) for k in keys]
        most = [bisect_right(cuts, k, key=lambda cut: cut[0][: len(k)]) for k in keys]  # noqa: B023
        place = [i for i, (a, b) in enumerate(zip(least, most)) for _ in range(a, b + 1)]
        slots = [s for a, b in zip(least, most) for s in range(a, b + 1)]
        taken = batch.take(pa.array(place, pa.int64()))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(slots, pa.int32())], names=[*batch.schema.names, "slot"])


class _Stack:
    """Open rules, outermost host first; each level holds the rules of one host by path."""

    def __init__(self):
        self.levels: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        """Drop the levels whose interval ended before ``key``."""
        while self.levels and not key.startswith(self.levels[-1][0]):
            self.levels.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.close(key)
        if not self.levels or self.levels[-1][0] != key:
            self.levels.append((key, {}, []))
        _, rules, lengths = self.levels[-1]
        if path not in rules or verdict > rules[path][1]:
            rules[path] = (rule, verdict)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def winner(self, key: str, path: str) -> tuple[str | None, str | None]:
        self.close(key)
        for _, rules, lengths in reversed(self.levels):
            for n in lengths:
                if n <= len(path) and (found := rules.get(path[:n])):
                    return found
        return None, None


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slot, key, urls after rules) in; rule and verdict of the urls out."""
    slot, stack, seen, answer = None, _Stack(), None, (None, None)
    for batch in batches:
        keep, rules, verdicts = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("slot", "is_url", "key", "path", "rule", "verdict")]
        for i, (s, is_url, key, path, rule, verdict) in enumerate(zip(*columns)):
            if s != slot:
                slot, stack, seen = s, _Stack(), None
            if not is_url:
                stack.open(key, path, rule, verdict)
                continue
            if seen != (key, path):
                seen, answer = (key, path), stack.winner(key, path)
            keep.append(i)
            rules.append(answer[0])
            verdicts.append(answer[1] or default)
        if keep:
            urls = batch.take(pa.array(keep, pa.int64()))
            out = [urls.column("row"), urls.column("host"), urls.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["row", "host", "path", "rule", "verdict"])


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``row``, host, path, rule and verdict of every row; ``rules`` has host, path and verdict.

    Select the columns to keep before the call: they travel with the url.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _rows(df, url)
    cuts = _cut_points(rows, parts)
    kind = rows.schema["row"].dataType
    urls = rows.mapInArrow(lambda b: _deal(b, cuts), StructType([*rows.schema, StructField("slot", IntegerType())]))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = rules.filter("verdict is not null").select(
        F.translate(text("host"), UPPER, LOWER).alias("host"), text("path").alias("path"), F.col("verdict").cast("string").alias("verdict")
    )
    key = F.when(F.col("host") == "", "").otherwise(host_key(F.col("host")))
    listed = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", key)
    spread = listed.mapInArrow(lambda b: _spread(b, cuts), "host string, path string, verdict string, key string, slot int")
    none = F.lit(None)
    # one sort puts the rules of a host before the urls that they fit
    asked = urls.select("slot", "key", F.lit(True).alias("is_url"), "path", none.cast("string").alias("rule"), none.cast("string").alias("verdict"), "host", "row")
    given = spread.select("slot", "key", F.lit(False).alias("is_url"), "path", F.concat("host", "path").alias("rule"), "verdict", "host", none.cast(kind).alias("row"))
    dealt = asked.unionByName(given).repartition(parts, "slot").sortWithinPartitions("slot", "key", "is_url", "path")
    names = ("host", "path", "rule", "verdict")
    return dealt.mapInArrow(lambda b: _sweep(b, default), StructType([StructField("row", kind), *[StructField(n, StringType()) for n in names]]))


ship(__name__)
