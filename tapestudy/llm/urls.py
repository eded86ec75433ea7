"""URL filters: pattern rules indexed by their rarest literal token.

A URL's tokens (host labels and path parts) fetch candidate rules from the index; only those run their regular
expression on host + path. Which token of a rule is the rarest is counted over all URLs of the table.

Nulls and edge cases: a null URL or one without `://` has an empty host and path and fits no rule; an empty path does not
start with `/`; repeated rows are judged alike; of rules with equal length the one that is listed first wins.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
MAX_RULE_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with the rule's path."""
    host: str
    path: str
    verdict: str
    tokens: frozenset = field(init=False)
    pattern: str = field(init=False)

    def __post_init__(self):
        parts = self.path.split("/")
        # the last part is open: a longer word may follow in the URL
        whole = {*self.host.split("."), *parts[1:-1]} - {""}
        object.__setattr__(self, "tokens", frozenset(whole))
        end = "" if self.path else r"(?=/|\Z)"
        object.__setattr__(self, "pattern", r"(?s:[^/]*\.)?" + re.escape(self.host) + re.escape(self.path) + end)

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(ASCII_LOWER), re.match(r"[^?#]*", rest[len(host):]).group()


def url_tokens(host: str, path: str) -> set[str]:
    return {*host.split("."), *path.split("/")} - {""}


def _tokens_column(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.array_distinct(F.concat(F.split(host, r"\."), F.split(path, "/")))


def token_counts(pages: DataFrame, url: str, tokens: set[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; the result has one row per rule token at most."""
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    seen = pages.select(F.explode(_tokens_column(F.col(f"`{url}`"))).alias("token"))
    return {r.token: r.n for r in seen.join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def rule_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """token -> rules whose rarest token it is, and the rules without any literal token."""
    index, always = defaultdict(list), []
    for i, r in enumerate(rules):
        if r.tokens:
            index[min(r.tokens, key=lambda t: (counts.get(t, 0), t))].append(i)
        else:
            always.append(i)
    return dict(index), always


def filter_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict per row. ``rules`` come from the caller and are sent to the tasks up to a checked size."""
    size = sum(len(r.name) + len(r.pattern) for r in rules)
    if size > MAX_RULE_BYTES:
        raise ValueError(f"{size} bytes of rules; split the list and combine the verdicts")
    pages = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"))
    index, always = rule_index(rules, token_counts(pages, "url", set().union(*(r.tokens for r in rules))) if rules else {})
    text = pa.string()
    schema = pa.schema([("page_id", pa.int64()), ("host", text), ("path", text), ("rule", text), ("verdict", text)])

    def run(batches):
        compiled = {}
        for b in batches:
            out = []
            for page, u in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist()):
                host, path = split_url(u)
                fits, best = host + path, None
                candidates = {i for t in url_tokens(host, path) if t in index for i in index[t]}
                for i in sorted(candidates.union(always)) if host or path else ():
                    if i not in compiled:
                        compiled[i] = re.compile(rules[i].pattern)
                    if compiled[i].match(fits) and (best is None or len(rules[i].name) > len(best.name)):
                        best = rules[i]
                out.append((page, host, path, best and best.name, best.verdict if best else default))
            if out:
                yield batch_of(schema, *zip(*out))

    return pages.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string").withColumnRenamed("page_id", key)
