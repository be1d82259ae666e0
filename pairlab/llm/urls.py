"""URL rules: a trie over reversed host labels and path segments, with longest-match precedence.

A rule is a host and a path prefix.  It fits its host and all subdomains if the url's path starts
with the rule's path.  Of the rules that fit, the longest decides; at equal length the longer
host, then block over allow.  The trie grows with the rules only; ``MAX_RULES`` bounds what is
broadcast, and more rules than that are an error.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.native import LOWER, UPPER
from pairlab.llm.tables import fresh

ALLOW, BLOCK = "allow", "block"
MAX_RULES = 2_000_000

Rule = tuple[str, str, str]  # verdict, host, path


class Trie:
    """Host labels from the right, then path segments; a rule ends in a partial last segment."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *full, partial = path.split("/")
            for segment in full:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            rank = (len(host) + len(path), len(host), verdict == BLOCK)
            ends = node.setdefault("ends", {})
            if partial not in ends or ends[partial][0] < rank:
                ends[partial] = (rank, host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The rule that decides, and its verdict; nothing if no rule fits."""
        best = None
        parts = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            at = node.get("paths")
            for segment in parts:
                if at is None:
                    break
                for partial, end in at.get("ends", {}).items():
                    if segment.startswith(partial) and (best is None or end[0] > best[0]):
                        best = end
                at = at.get("segments", {}).get(segment)
        return best[1:] if best else (None, None)


def judge(pages: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with host, path, rule and verdict (with underscores in front where a name is taken).

    Defined cases: a null url, and one without ``://``, has an empty host and path, fits no rule and
    gets ``default``; repeated rows are judged alike; long urls are read whole; an empty table gives
    an empty table.  Of equal rules the block entry counts.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    host, path, rule, verdict = (fresh(pages.columns, c) for c in ("host", "path", "rule", "verdict"))
    found = fresh(pages.columns, "found")

    @F.pandas_udf("rule string, verdict string")
    def decide(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        return pd.DataFrame([find(h, p) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"], dtype=object)

    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    parted = pages.withColumn(host, F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER)).withColumn(path, F.regexp_extract(text, pattern, 2))
    judged = parted.withColumn(found, decide(host, path))
    return judged.select(*pages.columns, host, path, F.col(f"{found}.rule").alias(rule), F.coalesce(F.col(f"{found}.verdict"), F.lit(default)).alias(verdict))
