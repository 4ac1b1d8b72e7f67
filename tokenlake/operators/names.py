"""Canonical model names: alias lookup and greedy rewriting, on distinct names only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aliases live in the plan as a map literal.
MAX_ALIASES = 20_000

# What the rewriting rules strip.
DATE_SUFFIXES = (r"-\d{8}$", r"-\d{6}$", r"@\d{8}$", r"-\d{4}-\d{2}-\d{2}$")
MODE_SUFFIXES = (":thinking", "-thinking", "-think", "-fast")
VARIANT_SUFFIXES = ("-latest", "-chat-latest", "-chat", "-preview")
PROVIDER_PREFIXES = ("zai-org-", "anthropic-", "openai-", "copilot-", "google-", "zai-", "deepseek-", "alibaba-", "minimax-")


def normal(name: Column) -> Column:
    return F.lower(F.trim(name))


def alias_map(aliases: dict[str, str]) -> Column:
    if len(aliases) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} aliases")
    return F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else F.create_map().cast("map<string,string>")


def _without(name: Column, pattern: str) -> Column:
    return F.regexp_replace(name, pattern, "")


def _first_change(name: Column, options: list[Column]) -> Column:
    """The first option that differs from the name, else the name."""
    out = F.when(options[0] != name, options[0])
    for o in options[1:]:
        out = out.when(o != name, o)
    return out.otherwise(name)


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def _dotted(name: Column, known: Column) -> Column:
    """One '-' between digits as '.', leftmost first, if that is an alias."""
    n = F.char_length(name)
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.regexp_like(F.substring(name, i - 1, F.lit(3)), F.lit(r"^\d-\d$")))
    tried = F.transform(places, lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.lit("."), F.substring(name, i + 1, n)))
    return F.coalesce(F.try_element_at(F.array_intersect(tried, known), F.lit(1)), name)


def _step(name: Column, known: Column) -> Column:
    base = _without(name, "@default$")
    date = F.coalesce(*[F.when(F.regexp_like(base, F.lit(p)), _without(base, p)) for p in DATE_SUFFIXES], base)
    slash = F.regexp_replace(name, "(?s)^[^/]*/(?=.)", "")
    return _first_change(
        name,
        [
            date,
            *[_without(name, _literal(x) + "$") for x in MODE_SUFFIXES],
            *[_without(name, _literal(x) + "$") for x in VARIANT_SUFFIXES],
            *[_without(name, "^" + _literal(x)) for x in PROVIDER_PREFIXES],
            slash,
            _dotted(name, known),
        ],
    )


def rewritten(name: Column, aliases: dict[str, str], rounds: int = 40) -> Column:
    """Greedy rewriting: the first rule that changes the name is kept, until an alias is met; null at a dead end."""
    found, known = alias_map(aliases), F.array(*[F.lit(a) for a in aliases]) if aliases else F.array().cast("array<string>")

    def step(state: Column, _: Column) -> Column:
        after = _step(state["name"], known)
        return F.when(state["done"], state).otherwise(
            F.struct(after.alias("name"), F.try_element_at(found, after).alias("found"), ((after == state["name"]) | F.try_element_at(found, after).isNotNull()).alias("done"))
        )

    start = F.struct(name.alias("name"), F.lit(None).cast("string").alias("found"), F.lit(False).alias("done"))
    end = F.reduce(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return F.when(end["name"] != name, end["found"])


def resolve_pairs(pairs: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(provider, model) with ``canonical``: provider/model alias, model alias, rewriting, else itself; null is '-'."""
    found, model = alias_map(aliases), normal(F.col("model"))
    both = F.concat(normal(F.coalesce("provider", F.lit(""))), F.lit("/"), model)
    name = F.coalesce(F.try_element_at(found, both), F.try_element_at(found, model), rewritten(model, aliases), model, F.lit("-"))
    return pairs.withColumn("canonical", name)


def canonicalise(usage: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """usage with ``canonical``; names are resolved once for each distinct pair."""
    pairs = resolve_pairs(usage.select("provider", "model").distinct(), aliases).select(F.col("provider").alias("_p"), F.col("model").alias("_m"), "canonical")
    return usage.join(pairs, F.col("provider").eqNullSafe(F.col("_p")) & F.col("model").eqNullSafe(F.col("_m")), "left").drop("_p", "_m")
