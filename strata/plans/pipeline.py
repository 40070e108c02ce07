"""Templated SQL models and pipelines of them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strata.operators import vault
from strata.operators.tables import append, last_per_key, merge
from strata.operators.versions import Txn, Versions
from strata.session import shared_dir

_BRACES = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_CALL = re.compile(r"(ref|source|vault)\(\s*'([\w.]+)'(?:\s*,\s*'([\w.]+)')?\s*\)")


def render(sql: str, incremental: bool = False, this: str = "this") -> tuple[str, dict[str, tuple[str, ...]]]:
    """SQL with view names in the place of ref, source, vault and this; the names with what they stand for."""
    relations: dict[str, tuple[str, ...]] = {}

    def branch(m: re.Match) -> str:
        parts = re.split(r"\{%\s*else\s*%\}", m[1])
        return parts[0] if incremental else parts[1] if len(parts) > 1 else ""

    sql = re.sub(r"\{%\s*if\s+is_incremental\(\)\s*%\}(.*?)\{%\s*endif\s*%\}", branch, sql, flags=re.S)

    def one(m: re.Match) -> str:
        body = (m[1] or "").strip()
        if m[1] is not None and body == "this":
            return this
        call = _CALL.fullmatch(body)
        if not call:
            raise ValueError(f"unknown expression: {m[0]}")
        name = "__".join(x.replace(".", "_") for x in call.groups() if x)
        relations[name] = tuple(x for x in call.groups() if x)
        return name

    return _BRACES.sub(one, sql), relations


def select(spark: SparkSession, sql: str) -> DataFrame:
    """A query's frame; statements that aren't one query are an error."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if "Command" in plan.getClass().getSimpleName() or plan.getClass().getSimpleName() in ("InsertIntoStatement", "CreateTableAsSelect", "DropTable", "CreateView", "SetCatalogAndNamespace"):
        raise ValueError("a model is one query")
    return spark.sql(sql)


def build(spark: SparkSession, sql: str, frames: dict[tuple[str, ...], DataFrame], this: DataFrame | None = None) -> DataFrame:
    """A templated model's frame: its references are the given frames, `this` its table so far (none: a first, full build).

    Names stand for views of this call alone, which are gone when the plan is made.
    """
    text, names = render(sql, this is not None)
    known = {n: frames[key] for n, key in names.items()} | ({"this": this} if this is not None else {})
    views = {n: f"_model_{uuid.uuid4().hex}" for n in known}
    try:
        for n, df in known.items():
            df.createTempView(views[n])
        named = ", ".join(f"`{n}` as (select * from {v})" for n, v in views.items())
        return select(spark, f"with {named} select * from (\n{text}\n)" if named else text)
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)


def materialise(new: DataFrame, target: DataFrame | None, kind: str = "table", unique_key: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """The model's table after a build: rebuilt, appended, or merged on a key (first build: all rows)."""
    if kind == "table" or target is None:
        return new
    if not unique_key:
        return append(target, new)
    if missing := [k for k in unique_key if k not in new.columns]:
        raise ValueError(f"unique key not in the model: {missing}")
    return merge(target, last_per_key(new, unique_key, order_by or unique_key), unique_key)


def order(models: dict[str, set[str]]) -> list[str]:
    """Models after what they need; a cycle is an error."""
    left, out = {k: {d for d in v if d in models} for k, v in models.items()}, []
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise ValueError(f"cycle among {sorted(left)}")
        out += ready
        left = {k: v - set(ready) for k, v in left.items() if k not in ready}
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Pipeline:
    """Models as functions of the frames they need; what fails or lacks an input blocks only what comes after it.

    A model is built when it is saved, so that a failure at run time is its own: by default as Parquet in the shared folder.
    """

    def __init__(self, models: dict[str, tuple[set[str], Callable[..., DataFrame]]]):
        self.models = models

    def run(self, inputs: dict[str, DataFrame], save: Callable[[str, DataFrame], DataFrame] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
        frames, states = dict(inputs), {}
        folder = uuid.uuid4().hex
        save = save or (lambda n, d: written(d, f"models-{folder}/{n}"))
        for name in order({k: v[0] for k, v in self.models.items()}):
            needs, build = self.models[name]
            if any(n not in frames for n in needs):
                states[name] = "skipped"
                continue
            try:
                frames[name] = save(name, build(**{n: frames[n] for n in needs}))
                states[name] = "succeeded"
            except Exception as e:  # a model's own failure is a state of the run
                states[name] = f"failed: {str(e)[:200]}"
        return frames, states


def load_raw_vault(source: DataFrame, name: str, spec: dict, targets: dict[str, DataFrame] | None = None, small: bool = False) -> dict[str, DataFrame]:
    """Rows to add to every table of one description: hub, satellites, status, links, in this order.

    spec: hub (entity, keys), satellites {name: attributes}, track_deletes, links {name: roles}. small: the source has few
    keys, so that targets are filtered by them first.
    """
    t, staged = targets or {}, vault.stage(source, name)
    entity, keys = spec["hub"]
    out = {f"hub_{entity}": vault.hub(staged, entity, keys, t.get(f"hub_{entity}"), small=small)}
    for s, attributes in spec.get("satellites", {}).items():
        out[f"sat_{s}"] = vault.satellite(staged, entity, keys, attributes, t.get(f"sat_{s}"), small=small)
    if spec.get("track_deletes"):
        out[f"sat_{entity}_status"] = vault.status_satellite(staged, entity, keys, t.get(f"sat_{entity}_status"), small=small)
    for link, roles in spec.get("links", {}).items():
        for role, cols in roles.items():
            if role != entity:
                out[f"hub_{role}"] = vault.hub(staged, role, cols, t.get(f"hub_{role}"), small=small)
        out[f"link_{link}"] = vault.link(staged, link, roles, t.get(f"link_{link}"), small=small)
    return out


def columns(spec: dict) -> set[str]:
    """Columns of a source that `load_raw_vault` reads, if the source has them."""
    roles = (cols for link in spec.get("links", {}).values() for cols in link.values())
    named = [spec["hub"][1], *spec.get("satellites", {}).values(), *roles]
    return {c for cols in named for c in cols} | {"_op", "_source_ts", "_load_ts", "_source", "_batch_id"}


#: Order in which mappings of one source are loaded.
KINDS = ("hub", "link", "satellite")


@dataclass(frozen=True)
class Mapping:
    """One vault table's load from a staged source: load(staged source, held rows) gives the rows to add."""

    kind: str
    name: str
    load: Callable[[DataFrame, DataFrame | None], DataFrame]
    enabled: bool = True


def load_plan(source: DataFrame, name: str, mappings: list[Mapping], tables: dict[str, Versions], dependents: dict[str, tuple[set[str], Callable[[dict[str, DataFrame]], DataFrame]]], txn: str) -> tuple[list[str], list[str]]:
    """Loads a source's enabled mappings (hubs, links, satellites, each by name), then rebuilds what depends on tables with new rows.

    A source without _load_ts is an error. dependents: name to (tables it reads, build). Gives the names loaded, in order,
    and the names rebuilt. The transaction id makes a second run add nothing.
    """
    staged = vault.stage(source, name).persist()
    loaded, fresh = [], set()
    try:
        for m in sorted((m for m in mappings if m.enabled), key=lambda m: (KINDS.index(m.kind), m.name)):
            t = tables[m.name]
            before = t.latest()
            if t.append(m.load(staged, None if before is None else t.read()), (f"{txn}:{m.name}", 0)) != before:
                fresh.add(m.name)
            loaded.append(m.name)
    finally:
        staged.unpersist()
    frames = {n: t.read() for n, t in tables.items() if t.latest() is not None}
    rebuilt = [n for n, (needs, _) in sorted(dependents.items()) if needs & fresh and needs <= set(frames)]
    for n in rebuilt:
        tables[n].write(dependents[n][1](frames), f"{txn}:{n}")
    return loaded, rebuilt


def maintain(table: Versions, added: DataFrame, keys: list[str], combine: Callable[[DataFrame], DataFrame], txn: Txn) -> tuple[DataFrame, DataFrame]:
    """An aggregate kept by key, brought up to date with rows that its source was given; its rows of those keys before and after.

    combine: one row per key, with the table's columns, of held and new rows together (new rows have the same columns).
    Only the keys in `added` are read and written. Under the same transaction a second run changes nothing and gives the
    same frames, as they come from the versions before and after, so whatever is built behind can follow from them.
    """
    if (version := table.made_by(txn)) is None:
        held = table.latest() is not None
        rows = added if not held else table.read().join(added.select(*keys).distinct(), keys, "left_semi").select(added.columns).unionByName(added)
        table.upsert(combine(rows), keys, txn=txn)
        version = table.made_by(txn)
    if version is None:
        return added.limit(0), added.limit(0)
    now = table.added(version)
    before = table.read(version - 1).join(now.select(*keys), keys, "left_semi").select(now.columns) if version else now.limit(0)
    return before, now
