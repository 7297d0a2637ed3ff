"""URL filters by a sort-merge range join of reversed-host keys with nested rules."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows (URLs and rules) that one range holds, about, the most ranges, which grow beyond that, and rows sampled for each
#: range's bounds. Only balance depends on these.
RANGE_ROWS, MOST_RANGES, SAMPLED = 10_000, 10_000, 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path as written; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def key(host: str) -> tuple[str, ...]:
    """Labels from the last to the first: a host and its subdomains are one interval in the order of keys."""
    return tuple(reversed(host.split(".")))


class Sweep:
    """Judges (key, path) pairs that come in order, with a stack of the rules whose host interval is open.

    Rules are sorted by key too. On a new host, rules whose interval ended leave the stack and those that begin enter it, so
    the stack is the chain of nested hosts. Inside a host the paths are sorted as well: a rule's path is an interval of them,
    and a second stack holds the nested open ones, longest on top.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.rules = sorted((key(h), p, h + p, v) for h, p, v in rules if h)
        self.at, self.hosts, self.host = 0, [], None
        self.paths, self.next, self.open = [], 0, []

    def _enter(self, k: tuple[str, ...]) -> None:
        while self.hosts and k[: len(self.hosts[-1][0])] != self.hosts[-1][0]:
            self.hosts.pop()
        while self.at < len(self.rules) and self.rules[self.at][0] <= k:
            rule = self.rules[self.at]
            self.at += 1
            if k[: len(rule[0])] == rule[0]:
                while self.hosts and rule[0][: len(self.hosts[-1][0])] != self.hosts[-1][0]:
                    self.hosts.pop()
                self.hosts.append(rule)
        self.host, self.next, self.open = k, 0, []
        self.paths = sorted((p, len(k_), name, v) for k_, p, name, v in self.hosts)

    def judge(self, k: tuple[str, ...], path: str) -> tuple[str, str] | None:
        if k != self.host:
            self._enter(k)
        while self.open and not path.startswith(self.open[-1][0]):
            self.open.pop()
        while self.next < len(self.paths) and self.paths[self.next][0] <= path:
            if path.startswith(self.paths[self.next][0]):
                self.open.append(self.paths[self.next])
            self.next += 1
        if not self.open:
            return None
        best = max(self.open, key=lambda x: (len(x[2]), x[2]))
        return best[2], best[3]


OUT = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("found", pa.string())])
DEALT = pa.schema([("range", pa.int32()), ("is_url", pa.bool_()), ("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())])
DEALT_DDL = "range int, is_url boolean, id long, host string, path string, verdict string"

Bounds = list[tuple[tuple[str, ...], str]]


def reaches(host: str, bounds: Bounds) -> range:
    """The ranges that the interval of a rule's host (itself and its subdomains) overlaps."""
    k = key(host)
    # equal bounds stand for a frequent key, whose rows are dealt over all ranges between them; after all (key, path) whose key begins with k
    end = bisect_left(bounds, True, key=lambda b: b[0][: len(k)] > k)
    return range(bisect_left(bounds, (k, "")), end + 1)


def _deal(bounds: Bounds):
    def place(host: str, path: str, nth: int) -> int:
        """A range for a URL: any for an empty host, which meets no rule, one of those between equal bounds, or the only one."""
        if not host:
            return nth % (len(bounds) + 1)
        k = key(host), path
        lo, hi = bisect_left(bounds, k), bisect_right(bounds, k)
        return hi if lo == hi else lo + 1 + nth % (hi - lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for nth, (is_url, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in DEALT.names[1:]))):
                at = (place(row[1], row[2], nth),) if is_url else reaches(row[1], bounds)
                rows += [(r, is_url, *row) for r in at]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(DEALT)], schema=DEALT)

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges one after the other: first the rules that reach into one, then its URLs in order."""
    at, rules, sweep = None, [], None
    for batch in batches:
        out = []
        for r, is_url, i, host, path, verdict in zip(*(batch.column(c).to_pylist() for c in DEALT.names)):
            if r != at:
                at, rules, sweep = r, [], None
            if not is_url:
                rules.append((host, path, verdict))
                continue
            sweep = sweep or Sweep(rules)
            found = sweep.judge(key(host), path) if host else None
            out.append((i, host, path, *(found or (None, None))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), OUT)], schema=OUT)


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", range_rows: int = RANGE_ROWS) -> DataFrame:
    """id, host, path, rule and verdict, one row per row of urls. rules has (host, path, verdict), all strings.

    A rule fits its host and all its subdomains when the path starts with the rule's; of several the one with the longest
    host + path wins, then the larger by code point; without one the verdict is default. URLs are dealt into ranges of
    key and path, so a hot host is spread over many, and so is a hot URL, which takes several equal bounds; a rule goes to each range that its host's interval overlaps, which
    are its own and those of URLs below it. Ranges are sorted and swept, whatever the number of rules. Bounds come from a
    sample of SAMPLED rows per range; only balance depends on it. Null or odd urls have an empty host and meet no rule, as
    does a rule with an empty or null host; a null path counts as empty; repeated rules are one, repeated rows are rows;
    no rows give no rows; other columns of urls are not read.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    df = urls.select(F.lit(True).alias("is_url"), F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("verdict"))
    rules = rules.select(F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("id"), "host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''").distinct()
    both = df.unionByName(rules)
    total = both.count()
    n = max(1, min(MOST_RANGES, -(-total // range_rows)))
    share = min(1.0, SAMPLED * n / max(1, total))
    some = sorted((key(r[0]), r[1]) for r in both.select("host", "path").where("host <> ''").sample(share, 7).collect()) if n > 1 else []
    bounds = [some[i * len(some) // n] for i in range(1, n)] if some else []
    dealt = both.mapInArrow(_deal(bounds), DEALT_DDL)
    reverse = F.reverse(F.split("host", r"\."))
    dealt = dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", "is_url", reverse, "path", "id")
    out = dealt.mapInArrow(_sweep, "id long, host string, path string, rule string, found string")
    return out.select("id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))
