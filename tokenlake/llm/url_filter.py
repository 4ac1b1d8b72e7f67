"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` plus the literal
tokens (runs of ``[a-z0-9]``) that any URL it fits must contain as whole
tokens. Each rule is filed under the one of its tokens that fewest URLs hold.
A URL's tokens look their rules up in that index, and only the rules so found
run their regular expression. All of it is built-in column functions: one
small aggregate (a row for each token of a rule), then a projection without
any shuffle, so that a hot host or a repeated URL costs nothing extra.

Edge cases: a null URL or one without ``://`` has empty host and path and no
rule fits it unless the rule needs no token at all; rules with no literal
token are tried on every URL; repeated rows are judged one by one; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rules live in the plan as literals; a longer list belongs in several passes.
MAX_RULES = 5_000


@dataclass(frozen=True)
class Rule:
    name: str
    action: str  # allow or block
    pattern: str  # over host + path
    tokens: tuple[str, ...]  # literals that every fitting host + path holds as whole tokens
    priority: int  # the highest wins, then the smaller name


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def _tokens(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def host_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with the given one; longer rules win."""
    whole, _, open_end = path.rpartition("/")  # what follows the last slash may go on
    pattern = rf"^(?:[^/]*\.)?{_literal(host)}(?=/|$){_literal(path)}"
    return Rule(host + path, action, pattern, tuple(dict.fromkeys(_tokens(host) + _tokens(whole))), 1_000 + len(host + path))


def word_rule(action: str, word: str) -> Rule:
    """Fits where the word is a whole token of the host; weaker than any host rule."""
    return Rule(word, action, rf"^(?:[^/]*[^a-z0-9/])?{_literal(word)}(?![a-z0-9])[^/]*(?:/|$)", tuple(_tokens(word)), len(word))


# Words in a host that mark advertising, gambling and adult sites.
DEFAULT_RULES = tuple(
    word_rule("block", w)
    for w in (
        "ads", "adserver", "advert", "banner", "bets", "betting", "casino", "click", "doubleclick",
        "escort", "gambling", "lottery", "poker", "popup", "porn", "sex", "slots",
        "spam", "track", "tracker", "tracking", "viagra", "warez", "xxx",
    )
)


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    none = F.lit("")
    return F.coalesce(host, none), F.coalesce(path, none)


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.concat(host, path)), "[^a-z0-9]+"), lambda t: t != ""))


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many of all rows hold each given token: one row for each token comes back."""
    held = (
        urls.select(F.explode(F.array_intersect(url_tokens(F.col("host"), F.col("path")), F.array(*map(F.lit, tokens)))).alias("token"))
        .groupBy("token")
        .count()
    )
    return {r["token"]: r["count"] for r in held.collect()}  # at most len(tokens) rows


def filter_urls(df: DataFrame, url: str, rules: tuple[Rule, ...], otherwise: str = "allow") -> DataFrame:
    """row (struct of df's columns), host, path, rule (name or null), action (its own, else ``otherwise``)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    host, path = split_url(df[url])
    parts = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), host.alias("host"), path.alias("path"))
    literal = sorted({t for r in rules for t in r.tokens})
    counts = token_counts(parts, literal) if literal else {}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else "", []).append(r)

    def entry(r: Rule) -> Column:
        return F.struct(
            F.lit(r.priority).alias("priority"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern")
        )

    if not index:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(otherwise)})
    by_token = F.create_map(*[x for t, rs in index.items() for x in (F.lit(t), F.array(*map(entry, rs)))])
    # the index is also a set of tokens, so that most tokens are dropped before any lookup
    keys = F.array(*[F.lit(t) for t in index if t])
    found = F.array_intersect(url_tokens(F.col("host"), F.col("path")), keys) if any(index) else F.array().cast("array<string>")
    if "" in index:
        found = F.concat(found, F.array(F.lit("")))
    candidates = F.flatten(F.transform(found, lambda t: F.element_at(by_token, t)))
    target = F.concat(F.col("host"), F.col("path"))
    fits = F.filter(candidates, lambda c: F.regexp_like(target, c["pattern"]))
    best = F.reduce(
        fits,
        F.lit(None).cast("struct<priority:int,name:string,action:string,pattern:string>"),
        lambda a, c: F.when(a.isNull() | (c["priority"] > a["priority"]) | ((c["priority"] == a["priority"]) & (c["name"] < a["name"])), c).otherwise(a),
    )
    return parts.withColumn("_best", best).withColumns(
        {"rule": F.col("_best")["name"], "action": F.coalesce(F.col("_best")["action"], F.lit(otherwise))}
    ).drop("_best")
