"""External models behind one interface: a registry of clients by name, run in Python workers, batch by batch.

``stub`` is deterministic and knows nothing: it answers with an empty result of the right shape, so that gates, retries and caches can
be run and tested without a model.
"""

from __future__ import annotations

import inspect
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_clients: dict[str, Callable[..., str]] = {}


def register(name: str, client: Callable[..., str]) -> None:
    _clients[name] = client


def chosen(name: str | None = None, settings: dict | None = None, default: str = "stub") -> str:
    """Environment before settings before default."""
    return name or os.environ.get("QUIRE_CLIENT") or (settings or {}).get("client") or default


def call(client: Callable[..., str], prompt: str, **options) -> str:
    """Only the options that the client's signature knows are passed."""
    known = inspect.signature(client).parameters
    every = any(p.kind is inspect.Parameter.VAR_KEYWORD for p in known.values())
    return client(prompt, **(options if every else {k: v for k, v in options.items() if k in known}))


register("stub", lambda prompt: '{"items": [], "chars": %d}' % len(prompt))


def answered(rows: DataFrame, prompt: str = "prompt", name: str | None = None, attempts: int = 3, **options) -> DataFrame:
    """rows with reply and error: a row that fails is tried again, and fails alone."""
    client = _clients[chosen(name)]

    def one(text):
        error = None
        for _ in range(attempts):
            try:
                return call(client, text or "", **options), None
            except Exception as e:  # noqa: BLE001  (an answer that can't be had is data)
                error = str(e)
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [one(x) for x in b[prompt]]
            yield b.assign(reply=[x[0] for x in found], error=[x[1] for x in found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", reply string, error string"
    return rows.mapInPandas(run, schema)


def cached(rows: DataFrame, cache: DataFrame, keys: list[str], value: str, prompt: str = "prompt", name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers to all rows, cache with the new ones): only keys the cache lacks are asked, each once; failures are not cached."""
    todo = rows.join(cache.select(*keys), keys, "left_anti").dropDuplicates(keys)
    new = answered(todo, prompt, name).where("reply is not null").select(*keys, F.col("reply").alias(value))
    full = cache.select(*keys, value).unionByName(new)
    return rows.join(full, keys, "left"), full
