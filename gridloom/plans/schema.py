"""Column rules, calculated columns and the plan that adds them.

A schema is a set of rules. A rule may check a column (type, nulls, bounds,
allowed values), rename or round it, or define it: by an expression, a lookup
or a function. Definitions are sorted by what they read, so each is added
after its inputs, and only those that a target needs are added at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expressions import names_in, round_half_even, to_column
from gridloom.functions.geometry import Geometry

POSITIONS = ("block_id", "world_id", "i", "j", "k", "x", "y", "z")
#: Spark's types of the position columns in storage.
POSITION_TYPES = {"block_id": "int", "world_id": "bigint", "i": "int", "j": "int", "k": "int", "x": "float", "y": "float", "z": "float"}


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Lookup:
    """A value for each key; ``default`` for keys that are not there."""

    key: str
    resolver: str | Mapping[Any, Any]
    default: Any = None


@dataclass(frozen=True)
class Function:
    """A registered function from Columns (the inputs, in order) and parameters to a Column."""

    name: str | Callable[..., Column]
    inputs: tuple[str, ...]
    params: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    name: str
    dtype: str | None = None
    nullable: bool = False
    required: bool = True
    coerce: bool = False
    alias_of: str | None = None
    decimals: int | None = None
    expr: str | None = None
    lookup: Lookup | None = None
    function: Function | None = None
    least: float | None = None
    most: float | None = None
    allowed: tuple | None = None
    title: str | None = None
    description: str | None = None
    is_attribute: bool = True
    compression: str | None = None

    @property
    def calculated(self) -> bool:
        return bool(self.expr or self.lookup or self.function)

    @property
    def inputs(self) -> set[str]:
        if self.expr:
            return names_in(self.expr)
        if self.lookup:
            return {self.lookup.key}
        return set(self.function.inputs) if self.function else set()


@dataclass(frozen=True)
class BlockSchema:
    rules: tuple[Rule, ...] = ()
    strict: bool | str = False  # "filter": columns without a rule go, positions stay

    def __post_init__(self):
        if len({r.name for r in self.rules}) < len(self.rules):
            raise SchemaError("two rules for one column")

    def rule(self, name: str) -> Rule | None:
        return next((r for r in self.rules if r.name == name), None)

    @classmethod
    def from_yaml(cls, text: str) -> BlockSchema:
        """``columns: {name: {dtype, nullable, coerce, required, title, description, checks, metadata}}``, ``strict``."""
        import yaml

        held = yaml.safe_load(text) or {}
        rules = []
        for name, spec in (held.get("columns") or {}).items():
            spec = spec or {}
            meta = spec.get("metadata") or {}
            ops = next((v for k, v in meta.items() if isinstance(v, dict) and set(v) & {"expr", "lookup", "function", "alias", "decimals"}), {})
            own = next((v for k, v in meta.items() if isinstance(v, dict) and set(v) & {"is_attribute", "compression"}), {})
            checks = spec.get("checks") or {}
            look, call = ops.get("lookup"), ops.get("function")
            rules.append(
                Rule(
                    name, spec.get("dtype"), spec.get("nullable", False), spec.get("required", True), spec.get("coerce", False), ops.get("alias"), ops.get("decimals"), ops.get("expr"),
                    Lookup(look["key"], look["resolver"], look.get("default")) if look else None,
                    Function(call["name"], tuple(call.get("inputs", ())), call.get("params") or {}) if call else None,
                    checks.get("greater_than_or_equal_to"), checks.get("less_than_or_equal_to"), tuple(checks["isin"]) if "isin" in checks else None,
                    spec.get("title"), spec.get("description"), own.get("is_attribute", True), own.get("compression"),
                )
            )
        return cls(tuple(rules), held.get("strict", False))

    def to_yaml(self) -> str:
        import yaml

        def spec(r: Rule) -> dict:
            ops: dict = {k: v for k, v in (("expr", r.expr), ("alias", r.alias_of), ("decimals", r.decimals)) if v is not None}
            if r.lookup:
                ops["lookup"] = {"key": r.lookup.key, "resolver": r.lookup.resolver if isinstance(r.lookup.resolver, str) else dict(r.lookup.resolver), "default": r.lookup.default}
            if r.function:
                ops["function"] = {"name": r.function.name, "inputs": list(r.function.inputs), "params": dict(r.function.params)}
            own = {k: v for k, v in (("is_attribute", r.is_attribute), ("compression", r.compression)) if v is not None}
            checks = {k: v for k, v in (("greater_than_or_equal_to", r.least), ("less_than_or_equal_to", r.most), ("isin", list(r.allowed) if r.allowed else None)) if v is not None}
            out = {"dtype": r.dtype, "nullable": r.nullable, "required": r.required, "coerce": r.coerce, "title": r.title, "description": r.description}
            return {k: v for k, v in out.items() if v is not None} | ({"checks": checks} if checks else {}) | {"metadata": {"calculation": ops, "block_model": own} if ops else {"block_model": own}}

        return yaml.safe_dump({"strict": self.strict, "columns": {r.name: spec(r) for r in self.rules}}, sort_keys=False)


@dataclass(frozen=True)
class Engine:
    """What definitions may refer to by name: lookup tables and functions."""

    resolvers: Mapping[str, Mapping[Any, Any]] = field(default_factory=dict)
    functions: Mapping[str, Callable[..., Column]] = field(default_factory=dict)

    def with_resolvers(self, **more: Mapping[Any, Any]) -> Engine:
        return replace(self, resolvers={**self.resolvers, **more})

    def with_functions(self, **more: Callable[..., Column]) -> Engine:
        return replace(self, functions={**self.functions, **more})


def definitions(schema: BlockSchema | None, geometry: Geometry | None) -> dict[str, Rule]:
    """All calculated columns by name: those of the schema, and the block volume unless the schema defines one."""
    out = {}
    if geometry is not None:
        out["volume"] = Rule("volume", "double", expr=repr(geometry.volume), required=False, is_attribute=False)
    return out | {r.name: r for r in (schema.rules if schema else ()) if r.calculated}


def needed(defined: Mapping[str, Rule], targets: Iterable[str]) -> list[Rule]:
    """The definitions that the targets need, each after its inputs; cycles are an error."""
    out: list[Rule] = []
    done: set[str] = set()

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in done or name not in defined:
            return
        if name in path:
            raise SchemaError(f"{' -> '.join((*path, name))} is a cycle")
        for x in sorted(defined[name].inputs - {name}):
            visit(x, (*path, name))
        done.add(name)
        out.append(defined[name])

    for t in targets:
        visit(t, ())
    return out


def defined_column(rule: Rule, engine: Engine) -> Column:
    if rule.expr:
        made = to_column(rule.expr)
    elif rule.lookup:
        table = rule.lookup.resolver if not isinstance(rule.lookup.resolver, str) else engine.resolvers[rule.lookup.resolver]
        pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
        found = F.try_element_at(F.create_map(*pairs), F.col(rule.lookup.key)) if pairs else F.lit(None)
        made = F.coalesce(found, F.lit(rule.lookup.default))
    else:
        call = rule.function.name if callable(rule.function.name) else engine.functions[rule.function.name]
        made = call(*(F.col(c) for c in rule.function.inputs), **rule.function.params)
    if rule.decimals is not None:
        made = round_half_even(made, rule.decimals)
    return made.cast(rule.dtype) if rule.dtype and rule.coerce else made


def calculate(df: DataFrame, schema: BlockSchema | None, geometry: Geometry | None, targets: Iterable[str], engine: Engine = Engine()) -> DataFrame:
    """df with the calculated columns among targets, and what these are made of."""
    for rule in needed(definitions(schema, geometry), [t for t in targets if t not in df.columns]):
        if rule.name not in df.columns:
            lacking = rule.inputs - set(df.columns)
            if lacking:
                raise SchemaError(f"{rule.name} needs {sorted(lacking)}")
            df = df.withColumn(rule.name, defined_column(rule, engine))
    return df


def prepare(df: DataFrame, schema: BlockSchema) -> DataFrame:
    """Source columns as the schema wants them: renamed, then rounded, then cast."""
    for r in schema.rules:
        if r.alias_of and r.alias_of in df.columns and r.name not in df.columns:
            df = df.withColumnRenamed(r.alias_of, r.name)
    changed = {}
    for r in schema.rules:
        if r.name in df.columns and not r.calculated:
            c = F.col(r.name)
            if r.decimals is not None:
                c = round_half_even(c, r.decimals)
            if r.coerce and r.dtype:
                c = c.cast(r.dtype)
            if r.decimals is not None or r.coerce:
                changed[r.name] = c
    return df.withColumns(changed) if changed else df


def stored_columns(df: DataFrame, schema: BlockSchema | None) -> list[str]:
    """Which columns a model keeps: positions first; with strict "filter" otherwise only those with a rule;
    calculated columns only if their rule says required."""
    defined = {r.name: r for r in (schema.rules if schema else ()) if r.calculated}
    rest = [c for c in df.columns if c not in POSITIONS]
    if schema and schema.strict == "filter":
        rest = [c for c in rest if schema.rule(c)]
    rest = [c for c in rest if c not in defined or defined[c].required]
    return [c for c in POSITIONS if c in df.columns] + rest


def persist_plan(df: DataFrame, schema: BlockSchema, geometry: Geometry | None, engine: Engine = Engine()) -> DataFrame:
    """What a model with this schema stores: aliases, decimals, required calculated columns, the strict filter."""
    df = prepare(df, schema)
    lasting = [r.name for r in schema.rules if r.calculated and r.required]
    df = calculate(df, schema, geometry, lasting, engine)
    defined = definitions(schema, geometry)
    return df.select(*[c for c in stored_columns(df, schema) if c not in defined or c in lasting])


def violations(df: DataFrame, schema: BlockSchema) -> DataFrame:
    """One row for each check that some row fails: column, check, rows. All checks in one aggregation."""
    spark = df.sparkSession
    found: list[tuple[str, str, Column | int]] = []
    kinds = dict(df.dtypes)
    for r in schema.rules:
        if r.name not in kinds:
            if r.required and not r.calculated:
                found.append((r.name, "missing", 1))
            continue
        c = F.col(r.name)
        if r.dtype and not r.coerce and kinds[r.name] != spark.createDataFrame([], f"c {r.dtype}").dtypes[0][1]:
            found.append((r.name, f"type {kinds[r.name]}", 1))
        empty = c.isNull() | (F.isnan(c) if kinds[r.name] in ("double", "float") else F.lit(False))
        if not r.nullable:
            found.append((r.name, "null", F.count_if(empty)))
        if r.least is not None:
            found.append((r.name, "too small", F.count_if(~empty & (c < r.least))))
        if r.most is not None:
            found.append((r.name, "too large", F.count_if(~empty & (c > r.most))))
        if r.allowed is not None:
            found.append((r.name, "not allowed", F.count_if(~empty & ~c.isin(list(r.allowed)))))
    if schema.strict is True:
        found += [(c, "unexpected", 1) for c in df.columns if c not in POSITIONS and not schema.rule(c)]
    if not found:
        return spark.createDataFrame([], "column string, check string, rows bigint")
    counted = df.agg(*(F.coalesce(x, F.lit(0)).cast("long").alias(f"c{n}") if isinstance(x, Column) else F.lit(x).cast("long").alias(f"c{n}") for n, (_, _, x) in enumerate(found)))
    rows = F.array(*(F.struct(F.lit(a).alias("column"), F.lit(b).alias("check"), F.col(f"c{n}").alias("rows")) for n, (a, b, _) in enumerate(found)))
    return counted.select(F.inline(rows)).where("rows > 0")


def attribute_flags(schema: BlockSchema | None, geometry: Geometry | None, columns: Iterable[str]) -> dict[str, bool]:
    """Which columns count as attributes: positions and intrinsic columns don't."""
    defined = definitions(schema, geometry)
    out = {}
    for c in [*columns, *(n for n in defined if n not in columns)]:
        rule = (schema.rule(c) if schema else None) or defined.get(c)
        out[c] = c not in POSITIONS and (rule.is_attribute if rule else True)
    return out


def descriptions(schema: BlockSchema, columns: Iterable[str]) -> dict[str, str]:
    """``title - description`` of the columns that have either."""
    out = {}
    for c in columns:
        if r := schema.rule(c):
            if said := " - ".join(x.strip() for x in (r.title, r.description) if x and x.strip()):
                out[c] = said
    return out
