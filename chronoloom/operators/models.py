"""Injected models over tables: batched calls, extraction, embeddings and level-wise summaries.

A model is a plain function the caller gives; it runs in Arrow batches on the executors, its errors become
columns, and nothing here depends on a provider.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions import jsonfix
from chronoloom.operators import sequences

Model = Callable[[list[str]], list[str]]


def complete(df: DataFrame, prompt: str, model: Model, batch: int = 50) -> DataFrame:
    """df with response and error: the model called on batches of prompts; a batch that fails is tried row by row."""
    schema = T.StructType([*df.schema, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return next(iter(model([text])), None), None
        except Exception as e:  # a model may raise anything; the row carries it
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                texts = part[prompt].fillna("").tolist()
                try:
                    got = [(r, None) for r in model(texts)]
                except Exception:  # told apart below
                    got = []
                if len(got) != len(texts):  # replies that cannot be told apart count as a failed batch
                    got = [one(t) for t in texts]
                yield part.assign(response=[r for r, _ in got], error=[e for _, e in got])

    return df.mapInPandas(run, schema)


#: What a prompt says besides when its reply had no usable JSON.
AGAIN = "\n\nThe reply before was no valid JSON object with the field {field}. Reply with that object only."


def structured(df: DataFrame, prompt: str, model: Model, field: str, retries: int = 2, batch: int = 50) -> DataFrame:
    """df with value (JSON of the field or null), how and attempts: replies salvaged and coerced.

    Prompts go in batches; those that fail go again together, with a word on what was wrong.
    """

    def ask(texts: list[str]) -> list[tuple]:
        try:
            got = list(model(texts))
        except Exception as e:  # a model may raise anything; the rows carry it
            got = [e] * len(texts)
        if len(got) != len(texts) or (len(texts) > 1 and isinstance(got[0], Exception)):
            return [x for t in texts for x in ask([t])] if len(texts) > 1 else [(None, "error: no reply")]
        out = []
        for g in got:
            try:
                v, how = (None, f"error: {type(g).__name__}") if isinstance(g, Exception) else jsonfix.salvage(g)
            except Exception as e:  # as above
                v, how = None, f"error: {type(e).__name__}"
            out.append((jsonfix.coerce(v, [field]), how))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f[prompt].fillna("").tolist()
            out: list = [None] * len(texts)
            left = list(range(len(texts)))
            for n in range(1, retries + 2):
                failed = []
                for i in range(0, len(left), batch):
                    some = left[i : i + batch]
                    for j, (v, how) in zip(some, ask([texts[j] if n == 1 else texts[j] + AGAIN.format(field=field) for j in some]), strict=True):
                        good = isinstance(v, dict) and field in v
                        out[j] = (json.dumps(v[field], ensure_ascii=False) if good else None, how if good or how.startswith("error") else "failed", n)
                        if not good:
                            failed.append(j)
                left = failed
            yield f.assign(value=[o[0] for o in out], how=[o[1] for o in out], attempts=[o[2] for o in out])

    return df.mapInPandas(run, T.StructType([*df.schema, T.StructField("value", T.StringType()), T.StructField("how", T.StringType()), T.StructField("attempts", T.IntegerType())]))


def extract_triples(chunks: DataFrame, key: str, text: str, entities: Model, relations: Model) -> DataFrame:
    """key, entities, triples, how: names first, then triples from text and names; a chunk that fails has none.

    Equal texts are asked once.
    """
    once = chunks.select(text).where(F.trim(text) != "").distinct()
    ner = structured(once, text, entities, "named_entities").select(text, F.coalesce(F.from_json("value", "array<string>"), F.array().cast("array<string>")).alias("entities"), F.col("how").alias("_h"))
    ask = ner.withColumn("_p", F.to_json(F.struct(F.col(text).alias("passage"), F.col("entities").alias("named_entities"))))
    rel = structured(ask, "_p", relations, "triples")
    cells = F.filter(F.coalesce(F.from_json("value", "array<array<string>>"), F.array().cast("array<array<string>>")), lambda t: F.size(t) == 3)
    got = rel.select(text, "entities", F.array_distinct(cells).alias("triples"), F.when(F.col("value").isNull(), F.col("how")).otherwise(F.greatest("how", "_h")).alias("how"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return chunks.select(key, text).join(got, text, "left").select(key, none("entities", "array<string>"), none("triples", "array<array<string>>"), F.coalesce("how", F.lit("empty")).alias("how"))


def embed_distinct(df: DataFrame, text: str, embed: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """df with vec: each distinct text goes through the model once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                t = f[text].iloc[i : i + batch].tolist()
                yield pd.DataFrame({text: t, "vec": list(np.asarray(embed(t), dtype=float))})

    once = df.select(text).where(F.col(text).isNotNull()).distinct()
    return df.join(once.mapInPandas(run, f"{text} string, vec array<double>"), text, "left").select(*df.columns, "vec")


def hashed_words(texts: list[str], size: int = 64) -> np.ndarray:
    """A model-free embedding: signed counts of words by the hash of each."""
    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            out[i, h % size] += 1 if h >> 63 else -1
    return out


def response_key(prompt: str, model: str, form: str):
    """Column: the key of a cached reply to prompt (a column's name)."""
    return F.sha2(F.to_json(F.struct(F.col(prompt).alias("prompt"), F.lit(model).alias("model"), F.lit(form).alias("response_format"))), 256)


def summaries(items: DataFrame, by: str, start: str, tie: str, text: str, widths: list[float], model: Model) -> DataFrame:
    """level, by, start, text: each level summarises the windows of the level below, narrow to wide."""
    out, level = None, items.select(by, F.col(start).cast("double").alias("start"), F.col(tie).cast("string").alias("tie"), F.col(text).alias("text"))
    for n, width in enumerate(widths):
        w = sequences.anchored_windows(level, by, "start", width)
        g = w.groupBy(by, "window_start").agg(F.sort_array(F.collect_list(F.struct("start", "tie", "text"))).alias("x"))
        ask = g.select(by, F.col("window_start").alias("start"), F.array_join(F.transform("x", lambda v: v["text"]), "\n").alias("prompt"))
        level = complete(ask, "prompt", model).select(by, "start", F.col("start").cast("string").alias("tie"), F.coalesce("response", F.lit("")).alias("text"))
        one = level.select(F.lit(n).alias("level"), by, "start", "text")
        out = one if out is None else out.unionByName(one)
    return out
