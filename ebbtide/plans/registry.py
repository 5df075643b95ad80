"""Named queries, each with the inventory lines it covers and an independent SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from .sqltext import CTE


@dataclass(frozen=True)
class Entry:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def with_tables(body: str) -> str:
    """Prefix `body` with the canonical views it mentions, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTE[name])
                needed.append(name)

    visit(body)
    body = body.strip()
    if not needed:
        return body
    head = ",\n".join(f"{n} AS ({CTE[n].strip()})" for n in needed)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, ids: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, ids, run, with_tables(sql) if sql else None)
        return fn
    return wrap
