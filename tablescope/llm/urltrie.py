"""URL allow/block rules in a trie over reversed host labels and path segments.

A rule is ``host/path``.  It fits its host and every subdomain when the URL's
path starts with the rule's path; the longest rule that fits decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("allow", "block")


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested dicts: host labels from the right, then whole path segments.

    Node keys: ``"h"`` next label, ``"p"`` root of the path part below this
    host, ``"s"`` next path segment, ``"t"`` list of (last path piece, rule,
    verdict, length); that piece is a prefix of what remains of the URL's path.
    """
    root: dict = {}
    for host, path, verdict in rules:
        if verdict not in VERDICTS:
            raise ValueError(f"verdict must be one of {VERDICTS}: {verdict!r}")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.setdefault("h", {}).setdefault(label, {})
        node = node.setdefault("p", {})
        *segments, tail = path.split("/")
        for segment in segments:
            node = node.setdefault("s", {}).setdefault(segment, {})
        node.setdefault("t", []).append((tail, host + path, verdict, len(host) + len(path)))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[int, str, str] | None:
    """(length, rule, verdict) of the longest rule that fits; a tie goes to block."""
    best = None
    labels = host.split(".")
    segments = path.split("/")
    node = trie
    for i, label in enumerate(reversed(labels), 1):
        node = node.get("h", {}).get(label)
        if node is None:
            break
        below = node.get("p")
        k = 0
        while below is not None:
            for tail, rule, verdict, length in below.get("t", ()):
                if (k < len(segments) and segments[k].startswith(tail)
                        and (best is None or (length, verdict, rule) > (best[0], best[2], best[1]))):
                    best = (length, rule, verdict)
            if k >= len(segments) - 1:
                break
            below = below.get("s", {}).get(segments[k])
            k += 1
    return best


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
               rules_per_trie: int = 200_000) -> DataFrame:
    """Append ``host``, ``path``, ``rule`` and ``verdict`` to the rows of ``df``.

    ``rules`` has string columns ``host, path, verdict`` (``allow``/``block``);
    rows with a null are no rules, equal rules count once.  A broadcast trie
    never holds more than ``rules_per_trie`` rules: a longer list is cut into
    blocks by hash, each block is a trie of its own, and the longest match over
    all blocks decides, so the size of the list does not bound the method.

    Null URLs and URLs without ``://`` have empty host and path, fit no rule
    and get ``default``.  An empty table gives an empty table.  Columns of
    ``df`` named like an output column are replaced.
    """
    spark = df.sparkSession
    clean = rules.select("host", "path", "verdict").dropna().distinct()
    blocks = max(1, -(-clean.count() // rules_per_trie))
    out = df.withColumns({"host": url_host(F.col(f"`{url}`")), "path": url_path(F.col(f"`{url}`"))})
    found = F.lit(None).cast("struct<length:int,verdict:string,rule:string>")

    def matcher(trie: Broadcast):
        def match(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            memo: dict = {}
            for hosts, paths in parts:
                if len(memo) > 100_000:
                    memo.clear()
                got = []
                for key in zip(hosts, paths):
                    if key not in memo:
                        memo[key] = longest_match(trie.value, *key)
                    got.append(memo[key] or (None, None, None))
                yield pd.DataFrame(got, columns=["length", "rule", "verdict"], index=hosts.index
                                   ).astype({"length": "Int32"})
        return match

    for b in range(blocks):
        part = clean if blocks == 1 else clean.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == b)
        trie = spark.sparkContext.broadcast(build_trie(tuple(r) for r in part.collect()))
        udf = F.pandas_udf(matcher(trie), "length int, rule string, verdict string")
        out = out.withColumn("_m", udf("host", "path"))
        found = F.greatest(found, F.when(F.col("_m.rule").isNotNull(), F.struct(
            F.col("_m.length").alias("length"), F.col("_m.verdict").alias("verdict"),
            F.col("_m.rule").alias("rule"))))
        out = out.withColumn("_best", found).drop("_m")
        found = F.col("_best")
    return (out.withColumn("rule", F.col("_best.rule"))
            .withColumn("verdict", F.coalesce(F.col("_best.verdict"), F.lit(default)))
            .drop("_best"))
