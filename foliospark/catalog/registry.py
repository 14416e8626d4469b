"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans.bindings import DUCK, NEEDS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sql(views: str, body: str, extra: dict[str, str] | None = None) -> str:
    """Oracle text: the named views as common table expressions followed by ``body``."""
    texts = {**DUCK, **(extra or {})}
    done: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in done:
            done.append(name)

    for view in views.split():
        add(view)
    if not done:
        return body.strip()
    ctes = ",\n".join(f"{name} as ({texts[name].strip()})" for name in done)
    body = body.strip()
    if body.startswith("with recursive"):
        return f"with recursive {ctes},\n{body[len('with recursive'):].strip()}"
    if body.startswith("with"):
        return f"with {ctes},\n{body[len('with'):].strip()}"
    return f"with {ctes}\n{body}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(views) -> DataFrame`` under a key, with an optional oracle."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap
