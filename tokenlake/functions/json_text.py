"""Texts inside JSON of unbounded nesting: sizes of all strings as JVM expressions, other walks as Arrow functions.

The Arrow functions take a JSON string. Each gives struct(text, chars, bytes): the texts joined by newlines, empty ones
left out, and the sums of their characters and UTF-8 bytes. Invalid JSON has none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def all_strings(v) -> Iterator[str]:
    """Every string at any depth, without keys."""
    todo = [v]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, dict):
            todo.extend(reversed(list(x.values())))


def text_value(v) -> Iterator[str]:
    """A string; an object's text, else value; arrays of such."""
    if isinstance(v, str):
        yield v
    elif isinstance(v, list):
        for x in v:
            yield from text_value(x)
    elif isinstance(v, dict):
        own = v["text"] if "text" in v else v.get("value")  # a text that is no string hides the value
        if isinstance(own, str):
            yield own


def rich_text(v) -> Iterator[str]:
    """Strings and arrays; of an object its text, then children, then node."""
    if isinstance(v, str):
        yield v
    elif isinstance(v, list):
        for x in v:
            yield from rich_text(x)
    elif isinstance(v, dict):
        if isinstance(v.get("text"), str):
            yield v["text"]
        if isinstance(v.get("children"), list):
            yield from rich_text(v["children"])
        if "node" in v:
            yield from rich_text(v["node"])


def nested_fields(v) -> Iterator[str]:
    """Strings and arrays; of an object what its text, value, output and content hold."""
    if isinstance(v, str):
        yield v
    elif isinstance(v, list):
        for x in v:
            yield from nested_fields(x)
    elif isinstance(v, dict):
        for k in ("text", "value", "output", "content"):
            if k in v:
                yield from nested_fields(v[k])


def message_content(v) -> Iterator[str]:
    """Of an array each item's text, else its nested fields."""
    if isinstance(v, list):
        for x in v:
            if isinstance(x, dict) and isinstance(x.get("text"), str):
                yield x["text"]
            else:
                yield from nested_fields(x)
    else:
        yield from nested_fields(v)


def as_text(v) -> str:
    """A string itself, anything else as JSON."""
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


MODES = {"all": all_strings, "text": text_value, "rich": rich_text, "nested": nested_fields, "message": message_content}


def json_text(value: Column, mode: str) -> Column:
    walk = MODES[mode]

    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for s in values:
            try:
                parts = [x for x in walk(json.loads(s)) if x] if s is not None else []
            except ValueError:
                parts = []
            out.append(("\n".join(parts), sum(map(len, parts)), sum(len(x.encode()) for x in parts)))
        return pd.DataFrame(out, columns=["text", "chars", "bytes"])

    return F.pandas_udf(run, "text string, chars long, bytes long")(value)


#: JSON's escapes, each with a text of the same number of characters and bytes: pairs of surrogates, then one to three bytes.
_ESCAPES = (
    (r"\\[\\\"/bfnrt]", "x"), (r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", "\U0001f600"),
    (r"\\u00[0-7][0-9a-fA-F]", "x"), (r"\\u0[0-7][0-9a-fA-F]{2}", "\u00e9"), (r"\\u[0-9a-fA-F]{4}", "\u6f22"),
)


def string_sizes(json_: Column) -> Column:
    """struct(chars, bytes) of every string value at any depth of a valid JSON text, keys left out; null: zeros.

    Built-in functions only: escapes give way to texts of their size, so that a string is
    what stands between two quotes; one before a colon is a key.
    """
    plain = json_
    for pattern, text in _ESCAPES:
        plain = F.regexp_replace(plain, pattern, text)
    plain = F.when(F.contains(json_, F.lit("\\")), plain).otherwise(json_)
    found = F.filter(F.regexp_extract_all(plain, F.lit(r'"[^"]*+"(?:\s*+:)?+'), 0), lambda x: x.endswith('"'))
    total = lambda size: F.coalesce(F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + size(x) - 2), F.lit(0))
    return F.struct(total(F.char_length).alias("chars"), total(F.octet_length).alias("bytes"))
