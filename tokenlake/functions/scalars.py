"""Scalar column functions over the usage schema, model names and text sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0)).cast("long")


def display_input() -> Column:
    return F.col("prompt") + F.col("cache_read") + F.col("cache_write")


def display_output() -> Column:
    return F.col("completion") + F.col("reasoning")


def date_bucket(ts: Column, unit: str = "day") -> Column:
    """UTC day YYYY-MM-DD, ISO week YYYY-Www, month YYYY-MM."""
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, "yyyy-MM" if unit == "month" else "yyyy-MM-dd")


def short_session(session_id: Column) -> Column:
    return F.when(F.char_length(session_id) > 14, F.concat(F.substring(session_id, 1, 14), F.lit("…"))).otherwise(session_id)


def project_of(name: Column, cwd: Column) -> Column:
    """Project name, else the last part of the working directory, else '-'."""
    base = F.substring_index(F.regexp_replace(cwd, "/+$", ""), "/", -1)
    return F.coalesce(name, F.when(base == "", cwd).otherwise(base), F.lit("-"))


def rough_tokens(chars: Column) -> Column:
    return F.ceil(chars / 4).cast("long")


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression: * crosses '/', ? is one character, [..] and [!..] are classes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
            while glob[i + 1 : i + 2] == "*":
                i += 1
        elif c == "?":
            out += "."
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += c if c.isalnum() or c in "_/ -" else "\\" + c
        i += 1
    return f"(?s)^{out}$"


def split_provider(name: Column, no_slash: str | None) -> tuple[Column, Column]:
    """(provider, model) of 'provider/model'; copilot is github-copilot; without a slash the given provider."""
    head, rest = F.substring_index(name, "/", 1), F.expr("NULL")
    rest = F.regexp_extract(name, r"(?s)^[^/]*/(.*)$", 1)
    has = F.contains(name, F.lit("/"))
    provider = F.when(has & (head == "copilot"), "github-copilot").when(has, head).otherwise(F.lit(no_slash))
    return provider, F.when(has, rest).otherwise(name)


# How canonical names say their family and series, first fit first; (prefix, pattern of the rest).
FAMILIES = (
    ("claude-", r"^claude-(haiku|sonnet|opus|fable)(?:-|$)"),
    ("claude-", r"^claude-\d+(?:\.\d+)?-(haiku|sonnet|opus|fable)(?:-|$)"),
    ("", r"^(gemini-[\d.]+-(?:flash(?:-lite)?|pro))(?:-|$)"),
    ("", r"^(gpt-\d+(?:\.\d+)?)(?:-|$)"),
    ("", r"^openai-(o\d+)(?:-|$)"),
)
SERIES = (
    ("claude-", r"^claude-(?:haiku|sonnet|opus|fable)-(\d+(?:\.\d+)?)"),
    ("claude-", r"^claude-(\d+(?:\.\d+)?)-(?:haiku|sonnet|opus|fable)(?:-|$)"),
    ("", r"^(gpt-\d+(?:\.\d+)?)"),
    ("", r"^(gemini-\d+(?:\.\d+)?)"),
    ("", r"^openai-(o\d+)"),
)
ROLES = "-(?:mini|nano|pro|flash|lite|turbo|codex|chat|reasoner|highspeed)$"


def _first_fit(name: Column, rules: tuple, otherwise: Column) -> Column:
    return F.coalesce(*[F.concat(F.lit(prefix), F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))) for prefix, pattern in rules], otherwise)


def infer_family(name: Column) -> Column:
    """Model family of a canonical name."""
    return _first_fit(name, FAMILIES, F.regexp_replace(name, ROLES, ""))


def infer_series(name: Column) -> Column:
    return _first_fit(name, SERIES, infer_family(name))
