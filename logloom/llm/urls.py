"""URL filters: host rules, then patterns fetched by their rarest literal token."""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of one block of patterns; more patterns are matched block by block.
BLOCK_CHARS = 8 << 20

HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# "||" a domain or subdomain begins here, "|" an end of the url, "*" anything, "^" a separator.
PATTERNS = (
    "||casino-win.", "||free-bets.", "||cheap-pills.", "||ads-track.", "-casino.", "||adserver.",
    "/ads/*/banner", "/adclick?", "&click_id=", "/popunder.", "|http://ads.", "||doubleclick^",
    "/xxx/", "-porn-", "/torrent/", "/pixel.gif|",
)

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Pattern:
    text: str
    regex: str
    tokens: tuple[str, ...]


def compile_pattern(text: str) -> Pattern:
    """The regular expression of a pattern, and the tokens every url it fits must have.

    A run of letters and digits is such a token only if the pattern itself
    bounds it on both sides, so that it is a whole token of the url.
    """
    body, head, tail = text.lower(), "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|") and body:
        body, tail = body[:-1], "$"
    regex = "".join(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in body)
    bound = []
    for m in TOKEN.finditer(body):
        left = bool(head) if m.start() == 0 else body[m.start() - 1] != "*"
        right = bool(tail) if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            bound.append(m.group())
    return Pattern(text, head + regex + tail, tuple(dict.fromkeys(bound)))


def url_host(url: str = "url") -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: str = "url") -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(rules=HOST_RULES, host: str = "host", path: str = "path") -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does.

    A rule fits its host, all subdomains of it, and paths that start with its own.
    """
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = (((F.col(host) == name) | F.col(host).endswith("." + name))
                & F.col(path).startswith("/" + rest))
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def url_tokens(url: str = "url") -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(url), F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def token_counts(urls: DataFrame, patterns: list[Pattern], url: str = "url") -> dict[str, int]:
    """In how many urls each token of the patterns occurs; one number per such token."""
    wanted = sorted({t for p in patterns for t in p.tokens})
    if not wanted:
        return {}
    known = F.array_intersect(url_tokens(url), F.lit(wanted))
    rows = urls.select(F.explode(known).alias("token")).groupBy("token").count().collect()
    return {w: 0 for w in wanted} | {r["token"]: r["count"] for r in rows}


def index_patterns(patterns: list[Pattern], counts: dict[str, int]) -> tuple[dict[str, list[Pattern]], list[Pattern]]:
    """Patterns by their rarest token, and those that have none."""
    index, always = defaultdict(list), []
    for p in patterns:
        if p.tokens:
            index[min(p.tokens, key=lambda t: (counts.get(t, 0), t))].append(p)
        else:
            always.append(p)
    return dict(index), always


def first_match(url: str | None, index: dict, always: list, compiled: dict) -> str | None:
    """The first pattern by text among those that fit; only fetched ones run."""
    if url is None:
        return None
    low = url.lower()
    fetched = [p for t in set(TOKEN.findall(low)) for p in index.get(t, ())] + always
    found = None
    for p in fetched:
        if found is None or p.text < found:
            rx = compiled.get(p.regex)
            if rx is None:
                rx = compiled[p.regex] = re.compile(p.regex, re.DOTALL)
            if rx.search(low):
                found = p.text
    return found


def _matcher(sent):
    @F.pandas_udf("string")
    def fits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (index, always), compiled = sent.value, {}
        for urls in batches:
            yield pd.Series([first_match(u, index, always, compiled) for u in urls], dtype="object")
    return fits


def match_patterns(urls: DataFrame, patterns=PATTERNS, url: str = "url") -> DataFrame:
    """``urls`` with ``pattern``: the first pattern by text that fits its url, else null.

    Token counts come from all urls. The index is sent to the tasks in blocks
    of BLOCK_CHARS, so that however many patterns there are, one block is all
    a task holds; urls never meet a pattern whose token they lack.
    """
    parsed = [compile_pattern(p) for p in sorted(set(patterns))]
    counts = token_counts(urls, parsed, url)
    blocks, size = [[]], 0
    for p in parsed:
        if size + len(p.text) > BLOCK_CHARS:
            blocks, size = [*blocks, []], 0
        blocks[-1].append(p)
        size += len(p.text)
    found = [_matcher(urls.sparkSession.sparkContext.broadcast(index_patterns(block, counts)))(F.col(url))
             for block in blocks]
    return urls.withColumn("pattern", found[0] if len(found) == 1 else F.least(*found))


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, pattern and verdict.

    The longest fitting host rule decides; without one a fitting pattern
    blocks and anything else is allowed. A null url, or one without "://", has
    an empty host and path and no rule; a null url fits no pattern. Rows are
    judged one by one, so repeated ids and urls keep their rows; input columns
    named like the results are replaced.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "pattern", "verdict")]
    named = match_patterns(pages.select(*own), patterns, url).withColumns(
        {"host": url_host(url), "path": url_path(url)})
    judged = named.withColumn("__rule", host_rule(host_rules))
    return judged.select(
        *own, "host", "path", F.col("__rule.rule").alias("rule"), "pattern",
        F.coalesce("__rule.verdict", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")).alias("verdict"))
