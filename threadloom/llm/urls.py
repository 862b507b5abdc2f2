"""URL filters by rules indexed under their rarest literal token (operator 5).

A rule is a regular expression over host and path together, with the literal tokens every match must hold. Each rule is filed
under the one of its tokens that fewest URLs have. A URL looks up its own tokens, and only the rules found there run. Equal
URLs are judged once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.llm.common import lower_ascii, small_side
from threadloom.session import cut_lineage

TOKEN = r"[0-9A-Za-z]+"
#: Rule tables up to this many rows are sent to every task; larger ones are joined by a shuffle.
BROADCAST_RULES = 200_000


class Rule(NamedTuple):
    rule: str
    verdict: str
    rank: int
    pattern: str
    tokens: list[str]


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and a path prefix. A last piece of the path that may go on is no token."""
    whole = re.findall(TOKEN, host) + re.findall(rf"{TOKEN}(?=[^0-9A-Za-z])", path)
    return Rule(host + path, verdict, len(host + path), rf"\A(?:[^/]*\.)?{_quoted(host + path)}", sorted(set(whole)))


def word_rule(verdict: str, word: str) -> Rule:
    """A rule for a word in the host, between its separators. It ranks below every prefix rule and names no rule in the result."""
    return Rule(f"~{word}", verdict, 0, rf"\A(?:[^/]*[.-])?{_quoted(word)}(?=[.\-:/]|\z)", sorted(set(re.findall(TOKEN, word))))


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z/])", r"\\\1", text)


#: The rules of the contract, and words in hosts that the method itself blocks.
CONTRACT_RULES = (
    prefix_rule("allow", "org", "/"), prefix_rule("block", "example.org", "/es/"), prefix_rule("block", "example.org", "/en/1"),
    prefix_rule("allow", "com", "/fr/"), prefix_rule("block", "com", "/de/"))
WORD_RULES = tuple(word_rule("block", w) for w in ("spam-farm", "cheap-pills", "casino", "free-money", "adult", "malware", "phishing", "warez"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host between ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z in lower case; path from there to ``?``, ``#`` or end.
    Both empty for null and for a URL without ``://``."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substr(url, place + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*(/[^?#]*)", 1)
    return lower_ascii(host), path


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rules as a table made of literals."""
    rows = [F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.rank).alias("rank"), F.lit(r.pattern).alias("pattern"),
                     F.array(*map(F.lit, r.tokens)).alias("tokens")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    ``rules`` as of :func:`rule_table`, each with at least one token. Among the rules that match, the highest rank wins, then the
    rule that comes last by name. A rule of rank 0 decides the verdict only; ``rule`` is null then, and where nothing matches,
    where the verdict is ``default``. Null, empty and broken URLs have an empty host and path and match nothing. Repeated rows
    each get their answer, an empty table gives no rows, other columns are not used.
    """
    host, path = host_and_path(F.col("url"))
    # Copies of a URL meet in a partial aggregate before the shuffle.
    urls = cut_lineage(pages.select("url").distinct().select("url", F.concat(host, path).alias("_subject")))
    words = urls.select("url", "_subject", F.explode(F.array_distinct(F.regexp_extract_all("_subject", F.lit(f"({TOKEN})")))).alias("token"))

    wanted = small_side(rules.select(F.explode("tokens").alias("token")).distinct(), BROADCAST_RULES)
    seen = words.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("_urls"))
    by_token = rules.select("rule", "verdict", "rank", "pattern", F.explode("tokens").alias("token")).join(seen, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("_urls", F.lit(0)), "token"))
    index = cut_lineage(by_token.groupBy("rule", "verdict", "rank", "pattern").agg(rarest.alias("token")))

    candidates = words.join(small_side(index, BROADCAST_RULES), "token")
    matched = candidates.filter(F.expr("_subject RLIKE pattern"))
    best = matched.groupBy("url").agg(F.max(F.struct("rank", "rule", "verdict")).alias("_best"))
    decided = best.select("url", F.when(F.col("_best.rank") > 0, F.col("_best.rule")).alias("rule"), F.col("_best.verdict").alias("verdict"))
    # A null URL matches nothing and stays out of the equi-join's hits by itself.
    return pages.select("page_id", "url", host.alias("host"), path.alias("path")).join(decided, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
