"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

The trie is broadcast (at most MAX_RULES entries); more entries are matched by an
equi-join on every (host suffix, path prefix) an URL has, so their number is not bounded.
The longest entry wins: more host labels first, then the longer path.

Defined cases: a url that is null or lacks ``://`` has an empty host and path and
gets no rule; a url without a rule gets the ``default`` verdict; repeated rows are
judged each by itself; of entries equal in host and path, block wins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Entries that may be broadcast; about 200 bytes each.
MAX_RULES = 100_000


def parse(rule: str) -> tuple[tuple[str, ...], str]:
    """Reversed host labels, and the path with its leading slash, of an entry like ``example.net/en/``."""
    host, slash, path = rule.partition("/")
    return tuple(reversed(host.lower().split("."))) if host else (), slash + path


class Trie:
    """Nodes are dicts: a host label leads on under ``label``, a path segment (with its slash) under ``/segment``.

    What follows an entry's last slash need not be a whole segment; it is kept in
    the node's list of tails, which match by prefix.
    """

    def __init__(self, allow: list[str], block: list[str]):
        self.root: dict = {}
        for verdict, rules in (("allow", allow), ("block", block)):
            for rule in rules:
                labels, path = parse(rule)
                node = self.root
                for label in labels:
                    node = node.setdefault(label, {})
                *segments, tail = path.split("/")
                for segment in segments:
                    node = node.setdefault("/" + segment, {})
                node.setdefault(None, {})[tail] = (rule, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        chain, node = [self.root], self.root
        for label in reversed(host.split(".")) if host else ():
            if (node := node.get(label)) is None:
                break
            chain.append(node)
        for node in reversed(chain):  # more host labels first
            walked, rest = [(node, path)], path
            while "/" in rest:
                segment, _, rest = rest.partition("/")
                if (node := node.get("/" + segment)) is None:
                    break
                walked.append((node, rest))
            for node, rest in reversed(walked):  # more of the path first
                tails = [t for t in node.get(None, ()) if rest.startswith(t)]
                if tails:
                    return node[None][max(tails, key=len)]
        return None


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, allow: list[str], block: list[str], default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    if len(allow) + len(block) > max_rules:
        return joined(parts, pages.sparkSession.createDataFrame([(r, v) for v, rules in (("allow", allow), ("block", block)) for r in rules], "rule string, verdict string"), default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(allow, block))

    def run(batches):
        seen: dict = {}
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = []
            if len(seen) > 100_000:
                seen.clear()
            for pair in zip(hosts, paths, strict=True):
                if pair not in seen:
                    seen[pair] = trie.value.match(*pair)
                found.append(seen[pair])
            rule, verdict = [f and f[0] for f in found], [f[1] if f else default for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(tk.tidy(run), "page_id long, host string, path string, rule string, verdict string")


def joined(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by equi-joins, for entries of any number: distinct (host, path) pairs meet the entries on host suffix and path prefix."""
    pairs = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    # an entry without a host fits every host
    suffixes = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))))
    entries = rules.select("rule", "verdict", F.lower(F.substring_index("rule", "/", 1)).alias("rule_host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rule_path"))
    entries = entries.groupBy("rule_host", "rule_path").agg(F.max_by("rule", "verdict").alias("rule"), F.max("verdict").alias("verdict"))
    # prefixes of the lengths that entries have; these are few, whatever the number of entries
    lengths = F.array(*(F.lit(r[0]) for r in entries.select(F.length("rule_path").alias("n")).distinct().orderBy("n").collect()))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = pairs.select("host", "path", F.explode(suffixes).alias("rule_host")).select("*", F.explode(prefixes).alias("rule_path"))
    order = F.struct(F.when(F.col("rule_host") == "", 0).otherwise(F.size(F.split("rule_host", r"\."))).alias("a"), F.length("rule_path").alias("b"))
    best = keys.join(entries, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
