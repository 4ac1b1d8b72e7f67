"""Catalog-side names: resolution with confidence, alias conflicts, audits, and prices in documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import stored
from .names import alias_map, normal

RULES = ("provider_prefix", "slash_prefix", "date_suffix", "mode_suffix", "variant_suffix", "version_separator")
PASSES = 6

# Prefixes that name a provider.
PREFIXES = "zai-org anthropic openai copilot google zai deepseek alibaba minimax xai mistral meta cohere moonshotai-cn moonshotai microsoft".split()


def _changed(rule: Column, name: Column, known: Column) -> Column:
    """The name after a rule, given by its number."""
    date = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "@default$", ""), r"[-@]\d{8}$", ""), r"-\d{4}-\d{2}-\d{2}$", ""), r"-\d{6}$", "")
    n = F.char_length(name)
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.regexp_like(F.substring(name, i - 1, F.lit(3)), F.lit(r"^\d-\d$")))
    dotted = F.transform(places, lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.lit("."), F.substring(name, i + 1, n)))
    return (
        F.when(rule == 0, F.regexp_replace(name, "^(?:" + "|".join(PREFIXES) + ")-", "")).when(rule == 1, F.regexp_replace(name, "(?s)^[^/]*/(?=.)", "")).when(rule == 2, date)
        .when(rule == 3, F.regexp_replace(name, "(?::thinking|-thinking|-think|-fast)$", "")).when(rule == 4, F.regexp_replace(name, "(?:-latest|-chat|-preview)$", ""))
        .otherwise(F.coalesce(F.try_element_at(F.array_intersect(dotted, known), F.lit(1)), name))
    )


def resolve_catalog(routes: DataFrame, aliases: dict[str, str], scoped: dict[tuple[str, str], str], rolling: set[str] = frozenset()) -> DataFrame:
    """(provider, model) with canonical_name, confidence, matched_by and is_rolling.

    An alias scoped to the provider wins; a name that is scoped to others only is
    unknown; then global aliases; then the rules in order, in up to PASSES
    passes, looking for an alias after every change. ``rolling`` are aliases.
    Each distinct (provider, model) is resolved once and joined back.
    """
    pairs = _resolve_pairs(routes.select("provider", "model").distinct(), aliases, scoped, rolling).withColumnsRenamed({"provider": "_p", "model": "_m"})
    return routes.join(pairs, F.col("provider").eqNullSafe(F.col("_p")) & F.col("model").eqNullSafe(F.col("_m")), "left").drop("_p", "_m")


def _resolve_pairs(routes: DataFrame, aliases: dict[str, str], scoped: dict[tuple[str, str], str], rolling: set[str]) -> DataFrame:
    found, name = alias_map(aliases), normal(F.col("model"))
    own = alias_map({f"{p}\x1f{a}": c for (p, a), c in scoped.items()})
    others = F.array(*[F.lit(a) for _, a in scoped]) if scoped else F.array().cast("array<string>")
    known = F.array(*[F.lit(a) for a in aliases]) if aliases else F.array().cast("array<string>")
    mine = F.try_element_at(own, F.concat(normal(F.coalesce("provider", F.lit(""))), F.lit("\x1f"), name))

    def step(s: Column, i: Column) -> Column:
        after = _changed(i % len(RULES), s["name"], known)
        hit = F.array_contains(others, after) | F.try_element_at(found, after).isNotNull()
        rule = F.element_at(F.array(*map(F.lit, RULES)), (i % len(RULES) + 1).cast("int"))
        stop = (after != s["name"]) & hit
        return F.when(s["rule"].isNotNull(), s).otherwise(F.struct(after.alias("name"), F.when(stop, rule).alias("rule")))

    start = F.struct(name.alias("name"), F.lit(None).cast("string").alias("rule"))
    end = F.reduce(F.sequence(F.lit(0), F.lit(PASSES * len(RULES) - 1)), start, step)
    # a generator is not copied into the expressions and filters above it, so the rules run once a name
    df = routes.withColumn("_end", F.explode(F.array(end))).withColumns({"_mine": mine, "_name": name})
    foreign, exact = F.array_contains(others, F.col("_name")), F.try_element_at(found, F.col("_name"))
    guess = F.when(F.col("_end.rule").isNotNull() & ~F.array_contains(others, F.col("_end.name")), F.try_element_at(found, F.col("_end.name")))
    empty = F.col("_name").isNull() | (F.col("_name") == "")
    same = F.when(F.col("model") == F.col("_name"), "exact").otherwise("normalized")
    how = lambda label: F.when(F.col("model") == F.col("_name"), label).otherwise("normalization")
    roll = F.array(*[F.lit(r) for r in rolling]) if rolling else F.array().cast("array<string>")
    pick = lambda a, b, c, d: F.when(empty, d).when(F.col("_mine").isNotNull(), a).when(foreign, d).when(exact.isNotNull(), b).when(guess.isNotNull(), c).otherwise(d)
    none = F.lit(None).cast("string")
    out = df.withColumns({
        "canonical_name": pick(F.col("_mine"), exact, guess, none), "confidence": pick(same, same, F.lit("heuristic"), F.lit("unknown")),
        "matched_by": pick(how("source_alias"), how("catalog_alias"), F.col("_end.rule"), none),
        "is_rolling": pick(F.array_contains(roll, F.col("_name")), F.array_contains(roll, F.col("_name")), F.array_contains(roll, F.col("_end.name")), F.lit(False)),
    })
    return out.drop("_end", "_mine", "_name")


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Of (provider or null, alias, canonical_name): aliases with two targets, and scoped ones that are also global."""
    a = aliases.select(normal(F.col("provider")).alias("provider"), normal(F.col("alias")).alias("alias"), "canonical_name")
    twice = a.groupBy("provider", "alias").agg(F.sort_array(F.collect_set("canonical_name")).alias("targets")).where(F.size("targets") > 1).select("provider", "alias", F.lit("two targets").alias("conflict"))
    both = a.where(F.col("provider").isNotNull()).join(a.where(F.col("provider").isNull()).select("alias").distinct(), "alias", "left_semi").select("provider", "alias", F.lit("scoped and global").alias("conflict"))
    return twice.union(both.distinct())


def resolution_audit(resolved: DataFrame, providers: list[str] | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Counts of routes by confidence for each provider and in total (provider null); of some providers, or of official sources only."""
    kinds = ("exact", "normalized", "heuristic", "unknown")
    rows = of_sources(resolved, sources) if sources is not None else resolved
    rows = rows.where(normal(F.col("provider")).isin([p.strip().lower() for p in providers])) if providers else rows
    return rows.rollup("provider").agg(F.count("*").alias("routes"), *[F.count(F.when(F.col("confidence") == k, 1)).alias(k) for k in kinds], F.grouping("provider").alias("total"))


def of_sources(routes: DataFrame, sources: DataFrame) -> DataFrame:
    """Routes of official sources, with ``vendor``: of the source with the longest prefix of the model.

    sources: (vendor, provider, model_prefix or null for all models of the provider). A provider's
    sources are gathered into one row each, a short list, so no route meets another.
    """
    prefix = F.coalesce("model_prefix", F.lit(""))
    lists = sources.select(F.col("provider").alias("_p"), F.struct(F.length(prefix).alias("n"), prefix.alias("prefix"), "vendor").alias("s")).groupBy("_p").agg(F.sort_array(F.collect_set("s"), asc=False).alias("_s"))
    fit = F.filter("_s", lambda s: F.startswith(F.col("model"), s["prefix"]))
    found = routes.join(lists, F.col("provider") == F.col("_p")).withColumn("_hit", F.try_element_at(fit, F.lit(1)))
    return found.where("_hit is not null").withColumn("vendor", F.col("_hit.vendor")).drop("_p", "_s", "_hit")


def unmatched_routes(resolved: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Routes (of official sources, if given) that no name was found for."""
    rows = of_sources(resolved, sources) if sources is not None else resolved
    return rows.where(F.col("confidence") == "unknown")


def route_identity(path: Column) -> tuple[Column, Column]:
    """(provider, model) of providers/<provider>/models/<model>.toml; the model may hold slashes."""
    pattern = r"^providers/([^/]+)/models/(.+)\.toml$"
    part = lambda k: F.nullif(F.regexp_extract(path, pattern, k), F.lit(""))
    return part(1), part(2)


def extract_prices(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """docs with the seven prices of a JSON document's ``cost``, as exact decimals; null without a cost.

    A cost needs input and output; older names are understood; a negative or
    non-numeric price is an error.
    """
    cost = F.get_json_object(doc, "$.cost")
    names = {
        "input": ["input"], "output": ["output"], "reasoning": ["reasoning"], "cache_read": ["cache_read", "inputCached", "input_cached"],
        "cache_write": ["cache_write", "outputCached", "output_cached"], "input_audio": ["input_audio", "audio_input"], "output_audio": ["output_audio", "audio_output"],
    }

    def price(name: str) -> Column:
        text = F.coalesce(*[F.get_json_object(doc, f"$.cost.{n}") for n in names[name]])
        number = text.try_cast("decimal(18,9)")
        bad = text.isNotNull() & (number.isNull() | (number < 0))
        lacks = text.isNull() if name in ("input", "output") else F.lit(False)
        error = lambda what: F.raise_error(F.lit(f"{what} {name} price")).cast("decimal(18,9)")
        return F.when(cost.isNull(), F.lit(None)).when(bad, error("invalid")).when(lacks, error("no")).otherwise(number)

    return docs.withColumns({n: price(n) for n in names})


_SEARCHED = ("provider", "model", "canonical_name", "family", "release_date")


def _holds(families: DataFrame, text: str, resolved_only: bool) -> Column:
    """Whether a route holds a text, whatever its case, and is resolved where it has to be."""
    out = F.lit(True)
    if resolved_only:
        out = F.coalesce("canonical_name", F.lit("")) != ""
    if text:
        hits = [F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in _SEARCHED if c in families.columns]
        out = out & F.array_contains(F.array(*hits), True)
    return out


def search_routes(families: DataFrame, text: str = "", provider: str | None = None, family: str | None = None, resolved_only: bool = False, page: int = 0, size: int = 100) -> DataFrame:
    """A page of routes whose provider, model, canonical_name, family or release_date holds the text, whatever its case."""
    rows = families.where(_holds(families, text, resolved_only))
    rows = rows.where(F.col("provider") == provider) if provider else rows
    rows = rows.where(F.col("family") == family) if family else rows
    return rows.orderBy("provider", "model").offset(page * size).limit(size)


def route_facets(families: DataFrame, text: str = "", provider: str | None = None, family: str | None = None, resolved_only: bool = False) -> DataFrame:
    """(facet, value, routes, chosen): how many routes each provider and each family has under all filters but its own.

    One pass over the routes and one shuffle of the values' partial counts. A
    value without routes under the filters stays with 0, as it can be chosen.
    """
    chosen = {"provider": provider, "family": family}
    fits = {f: F.coalesce(F.col(f) == v, F.lit(False)) if v else F.lit(True) for f, v in chosen.items()}
    rows = families.select(*chosen, _holds(families, text, resolved_only).alias("_in"), *[fit.alias(f"_{f}") for f, fit in fits.items()])
    sets = rows.groupingSets([[F.col("provider")], [F.col("family")]], "provider", "family").agg(
        F.grouping_id("provider", "family").alias("_g"), F.count_if(F.col("_in") & F.col("_family")).alias("_of_provider"), F.count_if(F.col("_in") & F.col("_provider")).alias("_of_family")
    )
    is_provider = F.col("_g") == 1
    out = sets.select(
        F.when(is_provider, "provider").otherwise("family").alias("facet"), F.when(is_provider, F.col("provider")).otherwise(F.col("family")).alias("value"),
        F.when(is_provider, F.col("_of_provider")).otherwise(F.col("_of_family")).alias("routes"),
    ).where(F.coalesce("value", F.lit("")) != "")
    is_chosen = F.lit(False)
    for f, v in chosen.items():
        is_chosen = is_chosen | (F.col("facet").eqNullSafe(f) & F.col("value").eqNullSafe(v))
    return out.withColumn("chosen", is_chosen)


def _merged(base: dict, over: dict) -> dict:
    return base | {k: _merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def _without(doc: dict, path: list[str]) -> dict:
    """doc without the field at a path; what lacks it stays."""
    head, *rest = path
    if head not in doc or (rest and not isinstance(doc[head], dict)):
        return doc
    return {k: (_without(v, rest) if k == head else v) for k, v in doc.items() if rest or k != head}


def _parents(doc: dict) -> list[str]:
    """Paths that a document builds on, the weaker first."""
    older = doc.get("extends")
    older = older.get("from") if isinstance(older, dict) else older
    out = [f"models/{doc['base_model']}.toml"] if doc.get("base_model") else []
    if older:
        provider, _, model = older.partition("/")
        out.append(f"providers/{provider}/models/{model}.toml")
    return out


def resolved_document(path: str, docs: dict[str, str | None], links: dict[str, str | None], above: tuple[str, ...] = ()) -> dict | None:
    """A document over those it builds on, without omitted fields; None where it, or what it links to, does not exist."""
    if path in above:
        raise ValueError("inheritance cycle: " + " -> ".join([*above, path]))
    if links.get(path):
        return resolved_document(links[path], docs, links, (*above, path))
    if docs.get(path) is None:
        return None
    own, value = json.loads(docs[path]), {}
    for p in _parents(own):
        value = _merged(value, resolved_document(p, docs, links, (*above, path)) or {})
    value = _merged(value, {k: v for k, v in own.items() if k not in ("base_model", "base_model_omit", "extends")})
    older = own.get("extends")
    for omit in [*own.get("base_model_omit", ()), *(older.get("omit", ()) if isinstance(older, dict) else ())]:
        value = _without(value, omit.split("."))
    return value


LAST_COMMIT = 2**62


def resolve_docs(versions: DataFrame, of: Column | None = None) -> DataFrame:
    """(path, since, until, doc): each route's document as resolved over spans of commits [since, until).

    versions: (commit_seq, path, doc JSON, target), a row for each change of a
    path; a link has its target's path, a removed path neither doc nor target.
    of: which paths to resolve (those of routes). A round joins all open spans
    with the versions of the next document that they need; a span that meets
    several versions is parted. A missing base is empty; a cycle is an error.
    """
    w = Window.partitionBy("path").orderBy("commit_seq")
    spans = versions.select("path", "doc", "target", F.col("commit_seq").cast("long").alias("since"), F.coalesce(F.lead("commit_seq").over(w), F.lit(LAST_COMMIT)).cast("long").alias("until"))
    # before its first version a path does not exist
    none = spans.groupBy("path").agg(F.min("since").alias("until")).select("path", F.lit(None).cast("string").alias("doc"), F.lit(None).cast("string").alias("target"), F.lit(-1).cast("long").alias("since"), "until")
    spans = stored(spans.unionByName(none), "spans")

    def needed(path: pd.Series, docs: pd.Series, links: pd.Series) -> pd.Series:
        out = []
        for d, t in zip(docs, links):
            d, t = dict(d), dict(t)
            up = [x for v in d.values() if v is not None for x in _parents(json.loads(v))] + [x for x in t.values() if x is not None]
            out.append(next((x for x in up if x not in d), None))
        return pd.Series(out, dtype=object)

    def merge(path: pd.Series, docs: pd.Series, links: pd.Series) -> pd.Series:
        done = [resolved_document(p, dict(d), dict(t)) for p, d, t in zip(path, docs, links)]
        return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in done], dtype=object)

    one = lambda c: F.create_map(F.col("path"), F.col(c))
    mine = spans.where(of if of is not None else route_identity(F.col("path"))[1].isNotNull()).where("doc is not null or target is not null")
    need = F.pandas_udf(needed, "string")
    rows = mine.select("path", "since", "until", one("doc").alias("docs"), one("target").alias("links")).withColumn("need", need("path", "docs", "links"))
    finished = None
    while True:
        rows = stored(rows, "resolving")
        done = rows.where("need is null")
        finished = done if finished is None else finished.unionByName(done)
        rows = rows.where("need is not null")
        if not rows.limit(1).count():
            break
        v = spans.select(F.col("path").alias("_p"), "doc", "target", F.col("since").alias("_since"), F.col("until").alias("_until"))
        joined = rows.join(v, (F.col("need") == F.col("_p")) & (F.col("since") < F.col("_until")) & (F.col("_since") < F.col("until")), "left")
        add = lambda m, c: F.map_concat(m, F.create_map(F.col("need"), F.col(c)))
        rows = joined.select("path", F.greatest("since", "_since").alias("since"), F.least("until", "_until").alias("until"), add("docs", "doc").alias("docs"), add("links", "target").alias("links"))
        rows = rows.withColumn("need", need("path", "docs", "links"))
    return finished.select("path", "since", "until", F.pandas_udf(merge, "string")("path", "docs", "links").alias("doc"))


def valid_release_date(text: Column) -> Column:
    """YYYY-MM or YYYY-MM-DD that is a date, else null."""
    day = F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}$")), F.concat(text, F.lit("-01"))).when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), text)
    return F.when(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull(), text)


def families(versions: DataFrame, aliases: dict[str, str], scoped: dict[tuple[str, str], str], rolling: set[str] = frozenset()) -> DataFrame:
    """(provider, model, canonical_name, family, release_date) of every route that ever was, with its last date."""
    from ..functions.scalars import infer_family

    provider, model = route_identity(F.col("path"))
    states = resolve_docs(versions).where("doc is not null").select(provider.alias("provider"), model.alias("model"), "since", valid_release_date(F.get_json_object("doc", "$.release_date")).alias("release_date"))
    last = states.groupBy("provider", "model").agg(F.max_by(F.struct("release_date"), "since").alias("x")).select("provider", "model", "x.release_date")
    out = resolve_catalog(last, aliases, scoped, rolling)
    return out.select("provider", "model", "canonical_name", F.when(F.col("canonical_name").isNotNull(), infer_family(F.col("canonical_name"))).alias("family"), "release_date")
