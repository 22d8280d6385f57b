"""Model output to values: salvaged JSON, schema repair, replies of the reasoning and filter steps, closest strings."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that models wrap a bare string in, the most specific first.
WRAPPERS = ("entity", "name", "value", "text")
_COMMENT, _TRAILING, _BAD = re.compile(r"//[^\n\"]*(?=\n|$)"), re.compile(r",(\s*[}\]])"), object()
_PAIR = {"{": "}", "[": "]"}
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[{}\[\]]', re.S)


def _load(text: str):
    try:
        return json.loads(text)
    except (json.JSONDecodeError, RecursionError):
        return _BAD


def balance(text: str) -> str:
    """Valid JSON as it is; else without what follows the last comma, open brackets closed."""
    if _load(text) is not _BAD:
        return text
    text = text.rpartition(",")[0] or text
    want: list[str] = []
    for t in _TOKENS.findall(text):
        if t in _PAIR:
            want.append(_PAIR[t])
        elif want and t == want[-1]:
            want.pop()
    return text + "".join(reversed(want))


def salvage(response: str | None) -> tuple[object, str]:
    """(value, how): clean, fenced, sliced, repaired or failed."""
    raw = (response or "").strip()
    if not raw:
        return None, "failed"
    body = re.sub(r"^```[^\n]*\n|^```", "", raw)
    body = _TRAILING.sub(r"\1", _COMMENT.sub("", body.removesuffix("```").strip()))
    at, to = body.find("{"), body.rfind("}")
    inner = _TRAILING.sub(r"\1", body[at : to + 1]) if 0 <= at < to else ""
    mend = lambda t: _TRAILING.sub(r"\1", balance(t)) if t else ""
    tries = [(raw, "clean"), (body, "fenced"), (inner, "sliced"), (mend(inner), "repaired"), (mend(body), "repaired"), (mend(body[at:]) if at >= 0 else "", "repaired")]
    return next(((v, how) for t, how in tries if t and (v := _load(t)) is not _BAD), (None, "failed"))


def _scalar(cell):
    if cell is None:
        return ""
    return " ".join(filter(None, (str(_scalar(c)) for c in cell))) if isinstance(cell, list) else cell


def _bare(x):
    if not isinstance(x, dict):
        return x
    return next((x[k] for k in WRAPPERS if k in x), next(iter(x.values()), ""))


def _items(xs):
    xs = [_bare(x) for x in xs]
    if xs and all(isinstance(x, list) for x in xs):
        return [[_scalar(c) for c in x] for x in xs]
    return ["" if x is None else x for x in xs]


def coerce(value, fields: list[str]):
    """A parsed value bent towards an object of these fields: bare lists wrapped, lone keys renamed, list items unwrapped,
    cells of rows made scalar, nulls in lists empty.  Anything else stays."""
    if isinstance(value, list) and len(fields) == 1:
        value = {fields[0]: value}
    if not isinstance(value, dict):
        return value
    if len(fields) == len(value) == 1:
        value = {fields[0]: next(iter(value.values()))}
    return {k: _items(v) if isinstance(v, list) else v for k, v in value.items()}


def salvaged(response: Column, fields: list[str] | None = None) -> Column:
    """struct(json, how) of model output, coerced to fields if given; json is null if it failed."""

    @F.pandas_udf("json string, how string")
    def run(s: pd.Series) -> pd.DataFrame:
        got = [salvage(x) for x in s]
        return pd.DataFrame({"json": [None if how == "failed" else json.dumps(coerce(v, fields) if fields else v, ensure_ascii=False) for v, how in got], "how": [how for _, how in got]})

    return run(response)


def reasoning_reply(response: Column) -> Column:
    """struct(decision, selected_memory) of the widest {...}; decision is answer where nothing parses."""
    r = F.from_json(F.regexp_extract(response, r"(?s)\{.*\}", 0), "decision string, selected_memory struct<memory_type: string, search_query: string>")
    return F.struct(F.coalesce(r["decision"], F.lit("answer")).alias("decision"), r["selected_memory"].alias("selected_memory"))


def filter_reply(response: Column, candidates: Column) -> Column:
    """Candidates named by the first [...] in its order; where that parses to none, those that stand anywhere in the text."""
    named = F.array_intersect(F.coalesce(F.from_json(F.regexp_extract(response, r"(?s)\[.*?\]", 0), "array<string>"), F.array().cast("array<string>")), candidates)
    return F.when(F.size(named) > 0, named).otherwise(F.filter(candidates, lambda c: response.contains(c)))


def sections(response: Column) -> Column:
    """map of field to text for replies in sections headed [[ ## field ## ]]."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), response), r"\n\s*\[\[ ## (?=\w+ ## \]\])"), lambda _, i: i > 0)
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\w+) ## \]\]", 1), F.trim(F.regexp_replace(p, r"^\w+ ## \]\]\s*", ""))))
    return F.map_from_entries(pairs)


def closest(text: Column, choices: Column) -> Column:
    """The choice with the best matching-blocks ratio to text, the first of equals by reverse order of text; null if no choice."""

    @F.pandas_udf("string")
    def run(s: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([next(iter(difflib.get_close_matches(t or "", [x for x in xs if x is not None], 1, 0.0)), None) if xs is not None else None for t, xs in zip(s, c, strict=True)], dtype=object)

    return run(text, choices)


def template(text: str) -> Callable[..., Column]:
    """A template with {name} places as a function of columns; a missing name is an error."""
    parts = re.split(r"\{(\w+)\}", text)

    def fill(**values: Column) -> Column:
        missing = set(parts[1::2]) - set(values)
        if missing:
            raise KeyError(f"no value for {', '.join(sorted(missing))}")
        return F.concat(*(values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)))

    return fill
