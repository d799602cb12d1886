"""URL filters: rules found by their rarest literal token."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[0-9A-Za-z_]+"
#: Rules sent to the tasks at once; a larger list is taken in several blocks.
BLOCK_RULES, BLOCK_CHARS = 100_000, 32 << 20


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in the lower-cased host followed by the path as it stands.

    ``name`` is reported; ``weight`` decides between rules that fit (the largest wins, then the first
    in the list); ``named`` rules report their name, the others only their verdict. ``tokens`` are
    literal tokens that every url the pattern fits has whole; without any, the rule runs on all urls.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    named: bool = True


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with its subdomains and the start of a path. Longer rules weigh more."""
    # the host's labels and the path's segments between two marks are whole tokens of any url that fits
    path_tokens = re.findall(rf"(?<=[^0-9A-Za-z_])({TOKEN})(?=[^0-9A-Za-z_])", path)
    tokens = tuple(dict.fromkeys(re.findall(TOKEN, host.lower()) + path_tokens))
    end = "" if path else r"(?=[/?#]|$)"
    return Rule(host + path, verdict, rf"^(?:[^/?#]*\.)?{re.escape(host.lower())}{re.escape(path) or end}", tokens, 1_000_000 + len(host) + len(path))


def word_rule(verdict: str, words: Sequence[str]) -> Rule:
    """Whole words next to each other in the host, joined by a hyphen or not a letter or digit."""
    gap = r"[-_.]"
    return Rule("-".join(words), verdict, rf"^[^/?#]*(?<![0-9A-Za-z_]){gap.join(map(re.escape, words))}(?![0-9A-Za-z_])", tuple(words), len(words), False)


#: Rules of the query: five host and path rules, then words in host names that mark advertising and spam.
RULES = (
    prefix_rule("block", "com", "/en/"), prefix_rule("allow", "example.com", "/en/7"), prefix_rule("allow", "net", "/de/"),
    prefix_rule("block", "example.net", "/de/8"), prefix_rule("block", "org", "/es/"),
    *[word_rule("block", w) for w in (("cheap", "pills"), ("casino", "win"), ("free", "bets"), ("spam", "farm"), ("ads", "track"))],
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    parts = lambda g: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", g)
    return F.translate(parts(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), parts(2)


def blocks(rules: Sequence[Rule]) -> Iterator[list[tuple[int, Rule]]]:
    """Rules with their place in the list, in runs of bounded size."""
    out: list[tuple[int, Rule]] = []
    size = 0
    for i, r in enumerate(rules):
        size += len(r.pattern) + len(r.name)
        if out and (len(out) >= BLOCK_RULES or size > BLOCK_CHARS):
            yield out
            out, size = [], len(r.pattern) + len(r.name)
        out.append((i, r))
    if out:
        yield out


def token_counts(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many urls each token of the rules occurs. The result is no larger than the rules."""
    spark = urls.sparkSession
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    want = spark.createDataFrame([(t,) for t in wanted], "token string")
    seen = urls.select(F.explode(F.array_distinct(F.regexp_extract_all("_at", F.lit(TOKEN), 0))).alias("token"))
    counted = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(want, "token", "left_semi")
    return {r["token"]: r["n"] for r in counted.collect()}


def index(rules: Sequence[tuple[int, Rule]], counts: dict[str, int]) -> tuple[dict[str, list], list]:
    """Rules by their rarest token, and those that have none and run everywhere."""
    by: dict[str, list] = defaultdict(list)
    everywhere = []
    for place, r in rules:
        entry = (-r.weight, place, r.pattern, r.name if r.named else None, r.verdict)
        if r.tokens:
            by[min(r.tokens, key=lambda t: (counts.get(t, 0), t))].append(entry)
        else:
            everywhere.append(entry)
    return dict(by), everywhere


def _matcher(by: dict[str, list], everywhere: list):  # noqa: ANN202
    cache: dict[str, re.Pattern] = {}

    def best(at: str) -> tuple[int | None, int | None, str | None, str | None]:
        found = None
        rules = list(everywhere)
        for t in set(re.findall(TOKEN, at)):
            rules += by.get(t, ())
        for e in sorted(rules, key=lambda e: e[:2]):  # the first that fits is the best
            pattern = cache.get(e[2])
            if pattern is None:
                pattern = cache[e[2]] = re.compile(e[2], re.DOTALL)
            if pattern.search(at):
                found = e
                break
        return (-found[0], found[1], found[3], found[4]) if found else (None, None, None, None)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([best(x) for x in s], columns=["weight", "place", "rule", "verdict"], dtype=object).astype({"weight": "Int64", "place": "Int64"})

    return run


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` plus host, path, rule and verdict.

    The heaviest rule that fits decides, the first of the list between equals. A url that no rule
    fits gets ``default``. A null url, or one without ``://``, has empty host and path, which only a
    rule that fits the empty string can judge. Rows are independent: copies get equal verdicts, an
    empty table gives no rows. Columns of ``pages`` named like an added one are replaced.

    Rules go to the tasks in blocks of bounded size, one column pass each; the pages are never
    shuffled. How rare a token is, is counted over all urls.
    """
    host, path = host_and_path(F.col(url))
    d = pages.withColumns({"host": host, "path": path}).withColumn("_at", F.concat("host", "path"))
    counts = token_counts(d, rules)
    found = []
    for k, block in enumerate(blocks(rules)):
        match = F.pandas_udf(_matcher(*index(block, counts)), "weight long, place long, rule string, verdict string")
        d = d.withColumn(f"_fit{k}", match("_at"))
        found.append(F.struct(F.col(f"_fit{k}.weight").alias("weight"), (-F.col(f"_fit{k}.place")).alias("place"), F.col(f"_fit{k}.rule").alias("rule"), F.col(f"_fit{k}.verdict").alias("verdict")))
    best = F.array_max(F.filter(F.array(*found), lambda x: x["weight"].isNotNull())) if found else F.lit(None).cast("struct<rule:string,verdict:string>")
    d = d.withColumn("_best", best)
    return d.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))}).drop("_at", "_best", *[f"_fit{k}" for k in range(len(found))])
