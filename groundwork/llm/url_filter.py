"""URL filters by pattern rules under a token index.

A rule has regular expressions for the host, path and query, and the literal tokens that every
matching URL holds. It is indexed under the one of them that the fewest of the URLs hold: these are
counted first, for the tokens of rules alone. A URL's own tokens fetch candidate rules, and only
those run their expressions. A rule without any literal is fetched by every URL. The matching rule
with the largest weight (for host rules: the longest) decides, of equal ones the last by name; where no
rule fits, ``allow``.

Small rule sets (up to ``max_inline_rules``) are a map literal in the plan: one narrow stage
without a shuffle, and no key can be hot. Larger sets are a table joined on the token, by distinct
URLs; a token that many URLs hold is only used for rules that have no rarer one, and adaptive
execution splits what is left of it. Null urls and urls without ``://`` have an empty host, path and
query, match no host rule and are allowed. Repeated rows are judged alike; an empty table gives no
rows; other columns are kept, those of the added names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .shared import ascii_lower


@dataclass(frozen=True)
class Rule:
    """``name`` as reported; ``tokens`` are literals that a matching URL's tokens must include;
    ``weight`` orders matching rules, the largest wins."""

    name: str
    verdict: str
    host: str
    path: str
    tokens: tuple[str, ...]
    weight: int
    named: bool = True
    query: str = ""


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``."""
    whole = [t for t in re.split(r"[/]+", path)[1:-1] if t and re.fullmatch(r"[a-z0-9]+", t)]
    return Rule(
        name=host + path,
        verdict=verdict,
        host=rf"(?s)\A(?:.*\.)?{re.escape(host)}\z",
        path=rf"\A{re.escape(path)}",
        tokens=(*host.split("."), *whole),
        weight=len(host) + len(path),
    )


def own_rule(name: str, tokens: Sequence[str], *, host: str = "", path: str = "", query: str = "") -> Rule:
    """A pattern of the method itself: it blocks where no given rule fits, and is not reported."""
    return Rule(name, "block", host, path, tuple(tokens), 0, False, query)


def as_word(word: str) -> str:
    """``word`` between borders of words, in either case."""
    return rf"(?i)(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])"


#: The four given rules.
GIVEN_RULES = (
    host_rule("block", "net", "/"),
    host_rule("allow", "example.net", "/en/"),
    host_rule("block", "example.com", "/de/"),
    host_rule("allow", "org", "/fr/"),
)

#: Words of hosts and of paths, and names of query fields, that the method itself blocks.
HOST_WORDS = ("adult", "casino", "lottery", "malware", "phishing", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
PATH_WORDS = ("casino", "phishing", "porn", "viagra", "warez", "xxx")
QUERY_FIELDS = ("jsessionid", "phpsessid", "sessionid")
METHOD_RULES = (
    *(own_rule(f"host:{w}", [w], host=as_word(w)) for w in HOST_WORDS),
    *(own_rule(f"path:{w}", [w], path=as_word(w)) for w in PATH_WORDS),
    *(own_rule(f"query:{w}", [w], query=rf"(?i)(?:\A|[&;]){w}=") for w in QUERY_FIELDS),
    own_rule("path:login form", ["wp", "login", "php"], path=r"(?i)/wp-login\.php\z"),
    own_rule("path:scripts", ["cgi", "bin"], path=r"(?i)/cgi-bin/"),
    own_rule("path:programs", ["exe"], path=r"(?i)\.exe\z"),
    own_rule("host:number", [], host=r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?\z"),
)


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(after), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^?#]*\?([^#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct runs of letters and digits; the empty one stands for rules without a literal."""
    parts = F.split(ascii_lower(F.concat_ws("/", F.lit(""), host, path, query)), r"[^a-z0-9]+")
    return F.array_distinct(F.concat(F.array(F.lit("")), parts))


def rarest_index(rules: Sequence[Rule], seen: Mapping[str, int]) -> dict[str, list[Rule]]:
    """Each rule under its token that the fewest URLs hold, of equal ones the last in the rule."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        key = min(reversed(r.tokens), key=lambda t: seen.get(t, 0)) if r.tokens else ""
        index.setdefault(key, []).append(r)
    return index


def count_tokens_of(rules: Sequence[Rule], tokens: DataFrame, max_inline: int) -> dict[str, int]:
    """How many rows of ``tokens`` (column tokens) hold each literal of the rules: one row of the
    result for each literal."""
    literals = sorted({t for r in rules for t in r.tokens})
    if len(literals) <= max_inline:
        held = tokens.select(F.explode(F.filter("tokens", lambda t: t.isin(literals))).alias("token"))
    else:
        known = tokens.sparkSession.createDataFrame([(t,) for t in literals], "token string")
        held = tokens.select(F.explode("tokens").alias("token")).join(known, "token", "left_semi")
    return {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}


_RULE = "struct<weight:int,rule:string,verdict:string,host:string,path:string,query:string>"


def _entry(r: Rule) -> Column:
    own = (F.lit(r.weight), F.lit(r.name if r.named else None).cast("string"), F.lit(r.verdict), F.lit(r.host), F.lit(r.path), F.lit(r.query))
    return F.struct(*[c.alias(n) for c, n in zip(own, ("weight", "rule", "verdict", "host", "path", "query"), strict=True)])


def _fits(host: Column, path: Column, query: Column) -> Column:
    at = zip(("__host", "__path", "__query"), (host, path, query), strict=True)
    host_ok, path_ok, query_ok = [(p == "") | F.regexp_like(F.col(c), p) for c, p in at]
    return host_ok & path_ok & query_ok


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], *, url_col: str = "url", max_inline_rules: int = 2000
) -> DataFrame:
    """``pages`` with host, path, rule and verdict. Columns of these names are replaced."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.col(f"`{url_col}`")
    df = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(url).alias("__host"), path_of(url).alias("__path"), query_of(url).alias("__query"))
    tokens = url_tokens(F.col("__host"), F.col("__path"), F.col("__query"))
    index = rarest_index(rules, count_tokens_of(rules, df.select(tokens.alias("tokens")), max_inline_rules)) if rules else {}
    if len(rules) <= max_inline_rules:
        df = df.withColumn("__best", _best_inline(index, tokens))
    else:
        df = _best_joined(df, index, tokens)
    return df.select(
        *[F.col(f"`{c}`") for c in keep], F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"),
        F.coalesce(F.col("__best.verdict"), F.lit("allow")).alias("verdict"),
    )


def _best_inline(index: dict[str, list[Rule]], tokens: Column) -> Column:
    if not index:
        return F.lit(None).cast(_RULE)
    rows = F.create_map(*[x for k, rs in sorted(index.items()) for x in (F.lit(k), F.array(*map(_entry, rs)))])
    known = F.filter(tokens, lambda t: t.isin(*sorted(index)))
    fetched = F.flatten(F.transform(known, lambda t: F.element_at(rows, t)))
    return F.array_max(F.filter(fetched, lambda r: _fits(r["host"], r["path"], r["query"])))


def _best_joined(df: DataFrame, index: dict[str, list[Rule]], tokens: Column) -> DataFrame:
    spark = df.sparkSession
    rows = [(k, r.weight, r.name if r.named else None, r.verdict, r.host, r.path, r.query) for k, rs in index.items() for r in rs]
    table = spark.createDataFrame(rows, "token string, weight int, rule string, verdict string, host_like string, path_like string, query_like string")
    urls = df.select("__host", "__path", "__query").distinct()
    hits = (
        urls.withColumn("token", F.explode(tokens))
        .join(table, "token")
        .where(_fits(F.col("host_like"), F.col("path_like"), F.col("query_like")))
        .groupBy("__host", "__path", "__query")
        .agg(F.max(F.struct("weight", "rule", "verdict")).alias("__best"))
    )
    return df.join(hits, ["__host", "__path", "__query"], "left")
