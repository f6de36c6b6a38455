"""Declarative detection rules as Spark predicates.

A rule is a mapping: id, level, layer, detection {name: selection, ..., condition}, optional aggregation {seconds,
min_count} and entity. A selection is a mapping (all must hold), a list of mappings (one must) or a list of keywords (one
must occur in the row). Field modifiers: contains, startswith, endswith, re, all. The condition is boolean SQL over the
selections' names, plus `1 of prefix*`, `all of prefix*` and `... of them`; Spark's own SQL reads it.
"""

from __future__ import annotations

import re
from fnmatch import fnmatchcase
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODIFIERS = ("contains", "startswith", "endswith", "re", "all")
REQUIRED = ("id", "level", "layer", "detection")


def load_rules(folder: str) -> list[dict]:
    """All rules of *.yml files below a folder, by path, several to a file; a rule without a required key is an error."""
    import yaml

    rules = [r for p in sorted(Path(folder).rglob("*.yml")) for r in yaml.safe_load_all(p.read_text(encoding="utf-8"))]
    for r in rules:
        if missing := [k for k in REQUIRED if k not in r] or [k for k in ("condition",) if k not in r["detection"]]:
            raise ValueError(f"rule {r.get('id')}: no {', '.join(missing)}")
    return rules


def column_of(df: DataFrame, field: str) -> tuple[Column, bool]:
    """A top-level column, a dotted one, or a field of ld, and whether it is an array; null if there is none."""
    at, kind = field.split("."), df.schema
    if at[0] not in df.columns:
        at = ["ld", *at]
    for name in at:
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return F.lit(None).cast("string"), False
        kind = kind[name].dataType
    return F.col(".".join(at)), isinstance(kind, T.ArrayType)


def _glob(value: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in value) + "$"


def _one(c: Column, value, how: str) -> Column:
    if value is None:
        return c.isNull()
    text = c.cast("string")
    if how == "re":
        return text.rlike(str(value))
    if how in ("contains", "startswith", "endswith"):
        return getattr(F.lower(text), how)(str(value).lower())
    if isinstance(value, bool):
        return text == str(value).lower()
    if isinstance(value, (int, float)):
        return text.try_cast("double") == float(value)
    if "*" in value or "?" in value:
        return F.lower(text).rlike("(?s)" + _glob(value.lower()))
    return F.lower(text) == value.lower()


def _field(df: DataFrame, name: str, value) -> Column:
    field, *mods = name.split("|")
    if odd := [m for m in mods if m not in MODIFIERS]:
        raise ValueError(f"modifier {odd[0]} is not known")
    how = next((m for m in mods if m != "all"), "equals")
    c, is_list = column_of(df, field)
    values = value if isinstance(value, list) else [value]

    def test(v) -> Column:
        return F.exists(c, lambda x: F.coalesce(_one(x, v, how), F.lit(False))) if is_list and v is not None else _one(c, v, how)

    tests = [test(v) for v in values]
    return reduce(Column.__and__ if "all" in mods else Column.__or__, (F.coalesce(t, F.lit(False)) for t in tests))


def selection(df: DataFrame, spec) -> Column:
    """Two-valued: a missing field is false, so that `not` makes it true."""
    if isinstance(spec, dict):
        tests = [_field(df, k, v) for k, v in spec.items()]
        return reduce(Column.__and__, tests)
    if all(isinstance(x, dict) for x in spec):
        return reduce(Column.__or__, (selection(df, x) for x in spec))
    row = F.lower(F.to_json(F.struct(*df.columns)))
    return reduce(Column.__or__, (F.coalesce(F.contains(row, F.lit(str(x).lower())), F.lit(False)) for x in spec))


def condition(rule: dict, names: str) -> str:
    """A rule's condition as Spark SQL over the struct `names` of its selections."""
    parts = [k for k in rule["detection"] if k != "condition"]

    def group(m: re.Match) -> str:
        found = [k for k in parts if m[2] == "them" or fnmatchcase(k, m[2])]
        return "(" + (" or " if m[1] == "1" else " and ").join(found) + ")" if found else "false"

    said = re.sub(r"\b(1|all) of (\w+\*?)", group, str(rule["detection"]["condition"]))
    return re.sub(r"\b(" + "|".join(map(re.escape, sorted(parts, key=len, reverse=True))) + r")\b", rf"{names}.`\1`", said)


def selections(df: DataFrame, rule: dict) -> Column:
    return F.struct(*(selection(df, v).alias(k) for k, v in rule["detection"].items() if k != "condition"))


def with_predicate(df: DataFrame, rule: dict, name: str) -> DataFrame:
    """df with a boolean column `name`: whether the rule's condition holds."""
    return df.withColumn(name, selections(df, rule)).withColumn(name, F.expr(condition(rule, f"`{name}`")))


def detect(events: DataFrame, rules: list[dict], layer_col: str = "layer") -> DataFrame:
    """events with rule_id, level, seconds and min_count, a row for each rule that a row matches; events are read once.

    Rows of layers without rules are left to the scan; a row's selections are worked out for its own layer's rules only.
    Two projections serve all rules: one for the selections, one for the conditions.
    """
    layer, hits = F.col(layer_col), []
    df = events.where(layer.isin(sorted({r["layer"] for r in rules})))
    df = df.withColumn("_said", F.struct(*(F.when(layer == r["layer"], selections(df, r)).alias(f"r{k}") for k, r in enumerate(rules))))
    for k, r in enumerate(rules):
        own = {"seconds": None, "min_count": 5} | r.get("aggregation", {})
        told = F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["level"]).alias("level"), F.lit(own["seconds"]).cast("long").alias("seconds"), F.lit(own["min_count"]).cast("long").alias("min_count"))
        hits.append(F.when((layer == r["layer"]) & F.expr(condition(r, f"_said.r{k}")), told))
    # of explode() Spark makes a filter that asks every rule a second time
    return df.withColumn("_hit", F.explode_outer(F.array_compact(F.array(*hits)))).where("_hit is not null").select(*events.columns, "_hit.*")
