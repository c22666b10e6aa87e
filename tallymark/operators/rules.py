"""Business rules on one dataset.

A rule becomes one of two shapes. Row rules are a ``scope`` and a ``bad`` condition per row:
all row rules of a table are counted in one fused aggregate, and offenders are one filter.
Group rules fold the scope to one row per group and test the group.
Filters and conditions are Spark SQL expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import normalize as nz
from tallymark.functions import scalars as sc
from tallymark.operators.checks import need_columns, types_of, verdict
from tallymark.operators.counters import Tally
from tallymark.operators.diff import Keep, rows_with_repeated_keys

ROW_RULES = ("value_equals", "allowed_values", "not_allowed", "conditional", "flag_override",
             "not_null", "range", "valid_expr", "must_exist", "must_not_exist")
GROUP_RULES = ("unique", "combine", "split")


@dataclass(frozen=True)
class Rule:
    """A rule as declared: type, parameters and an optional scope filter."""

    rule_id: str
    rule_type: str
    params: Mapping[str, object] = field(default_factory=dict)
    filter: str | None = None


def _holds(expression: str) -> Column:
    """A condition that counts as not met when it is NULL."""
    return F.coalesce(F.expr(expression), F.lit(False))


def _param(rule: Rule, name: str):
    value = rule.params.get(name)
    if value is None or value == "" or value == []:
        raise ValueError(f"rule {rule.rule_id}: parameter {name!r} is required")
    return value


def _column(rule: Rule, df: DataFrame) -> str:
    name = _param(rule, "column")
    need_columns(df, [name])
    return name


def _names(rule: Rule, df: DataFrame, *params: str) -> list[str]:
    for param in params:
        value = rule.params.get(param)
        if value:
            names = [value] if isinstance(value, str) else [v for v in value if v]
            need_columns(df, names)
            return names
    raise ValueError(f"rule {rule.rule_id}: parameter {params[0]!r} is required")


@dataclass(frozen=True)
class RowRule:
    """Rows in ``scope`` are checked; those that are also ``bad`` violate the rule."""

    scope: Column
    bad: Column
    columns: tuple[str, ...]
    condition: str


def row_rule(rule: Rule, df: DataFrame) -> RowRule:
    """Conditions of a row rule over the columns of ``df``; both are never NULL."""
    scope = _holds(rule.filter) if rule.filter else F.lit(True)
    kind, p = rule.rule_type, rule.params
    if kind in ("must_exist", "must_not_exist"):
        bad = F.lit(kind == "must_not_exist")
        built = RowRule(scope, bad, (), kind.replace("_", " "))
    elif kind == "valid_expr":
        expression = _param(rule, "valid_expr")
        built = RowRule(scope, ~_holds(expression), (), f"rows must satisfy: {expression}")
    elif kind in ROW_RULES:
        name = _column(rule, df)
        c, dtype = nz.col(name), types_of(df)[name]
        expected = p.get("expected", p.get("value"))
        if kind == "value_equals":
            bad, says = ~sc.loosely_equals(c, dtype, expected), f"{name} must equal {expected!r}"
        elif kind in ("conditional", "flag_override"):
            when = _param(rule, "when")
            scope = scope & _holds(when)
            bad = ~sc.loosely_equals(c, dtype, expected)
            says = f"when {when}: {name} must equal {expected!r}"
        elif kind == "allowed_values":
            bad = ~sc.loosely_in(c, dtype, p.get("allowed_values") or [])
            says = f"{name} must be one of {p.get('allowed_values')}"
        elif kind == "not_allowed":
            bad = sc.loosely_in(c, dtype, p.get("allowed_values") or [])
            says = f"{name} must not be any of {p.get('allowed_values')}"
        elif kind == "not_null":
            bad, says = nz.nullish(c, dtype), f"{name} must not be null"
        else:  # range
            low, high = p.get("min"), p.get("max")
            value = sc.plain_number(c, dtype)
            inside = F.lit(True)
            if low is not None:
                inside = inside & (value >= float(low))
            if high is not None:
                inside = inside & (value <= float(high))
            bad = ~F.coalesce(inside, F.lit(False))
            says = f"{name} must be within [{low}, {high}]"
        built = RowRule(scope, bad, (name,), says)
    else:
        raise ValueError(f"unknown rule_type {kind!r}")
    df.select(built.scope, built.bad)  # analysis only: a bad expression fails here
    return built


def row_rule_status(rule: Rule, checked: Column, violations: Column) -> Column:
    if rule.rule_type == "must_exist":
        return verdict(checked >= int(rule.params.get("min_count", 1)))
    return verdict(violations == 0)


def row_rule_tally(rule: Rule, df: DataFrame) -> Tally:
    """Counts of a row rule, to be fused with others of the same table."""
    built = row_rule(rule, df)
    return Tally(
        {"checked": F.count_if(built.scope), "violations": F.count_if(built.scope & built.bad)},
        lambda n: [F.struct(
            F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.rule_type).alias("rule_type"),
            n["checked"].alias("checked_rows"), n["violations"].alias("violations"),
            row_rule_status(rule, n["checked"], n["violations"]).alias("status"))])


def group_rule(rule: Rule, df: DataFrame) -> DataFrame:
    """One row per group of a group rule: the group, its size ``n`` and ``bad``.

    ``unique`` groups by its columns (a group is bad when it repeats), ``combine`` and
    ``split`` by ``group_by``. NULL forms a group of its own.
    """
    scoped = df.where(_holds(rule.filter)) if rule.filter else df
    p = rule.params
    size = F.count(F.lit(1))
    if rule.rule_type == "unique":
        groups, bad = _names(rule, df, "columns", "column"), F.col("n") > 1
    elif rule.rule_type == "combine":
        groups, bad = _names(rule, df, "group_by"), F.col("n") != int(p.get("expect_count", 1))
    elif rule.rule_type == "split":
        groups = _names(rule, df, "group_by")
        if p.get("type_column"):
            kinds = _names(rule, df, "type_column")[0]
            size, bad = F.count_distinct(nz.col(kinds)), F.col("n") < int(p.get("expect_distinct", 2))
        else:
            bad = F.col("n") < int(p.get("min_count", 2))
    else:
        raise ValueError(f"unknown rule_type {rule.rule_type!r}")
    return scoped.groupBy(*[nz.col(g) for g in groups]).agg(size.alias("n")).withColumn("bad", bad)


def counted_groups(rule: Rule, df: DataFrame) -> list[str] | None:
    """The columns by which a rule counts rows; None for a rule that counts distinct values instead."""
    if rule.rule_type == "unique":
        return _names(rule, df, "columns", "column")
    if rule.rule_type == "split" and rule.params.get("type_column"):
        return None
    return _names(rule, df, "group_by")


def group_counters(rule: Rule, here: Column, size: Column) -> dict[str, Column]:
    """Aggregates of a rule over rows that are groups with their ``size`` where ``here`` holds."""
    p = rule.params
    bad = here & (size > 1 if rule.rule_type == "unique" else size < int(p.get("min_count", 2))
                  if rule.rule_type == "split" else size != int(p.get("expect_count", 1)))
    rows = size if rule.rule_type == "unique" else F.lit(1)
    return {"groups": F.count_if(here), "bad_groups": F.count_if(bad),
            "checked_rows": F.coalesce(F.sum(F.when(here, size)), F.lit(0)),
            "violations": F.coalesce(F.sum(F.when(bad, rows)), F.lit(0)).cast("bigint")}


def group_rule_totals(rule: Rule, df: DataFrame) -> DataFrame:
    """Groups, bad groups and, for ``unique``, the rows in them."""
    rows = F.col("n") if rule.rule_type == "unique" else F.lit(1)
    return group_rule(rule, df).agg(
        F.count(F.lit(1)).alias("groups"), F.count_if("bad").alias("bad_groups"),
        F.coalesce(F.sum(F.col("n")), F.lit(0)).alias("checked_rows"),
        F.coalesce(F.sum(F.when(F.col("bad"), rows)), F.lit(0)).cast("bigint").alias("violations"),
    ).withColumn("status", verdict(F.col("bad_groups") == 0))


def offenders(rule: Rule, df: DataFrame, keys: Sequence[str] = (),
              keep: Keep | None = None) -> DataFrame:
    """Violating rows (keys and the tested columns), or violating groups."""
    if rule.rule_type in ("combine", "split"):
        distinct = rule.rule_type == "split" and rule.params.get("type_column")
        name = f"distinct_{rule.params['type_column']}" if distinct else "row_count"
        return group_rule(rule, df).where("bad").drop("bad").withColumnRenamed("n", name)
    if rule.rule_type == "unique":
        columns = _names(rule, df, "columns", "column")
        scoped = df.where(_holds(rule.filter)) if rule.filter else df
        bad = rows_with_repeated_keys(scoped, columns, keep)
    else:
        built = row_rule(rule, df)
        columns, bad = built.columns, df.where(built.scope & built.bad)
        if rule.rule_type == "must_exist":
            return bad.limit(0)
    shown = list(dict.fromkeys([*keys, *columns]))
    if not shown or rule.rule_type == "must_not_exist" or not set(shown) <= set(df.columns):
        return bad
    return bad.select(*[nz.col(c) for c in shown])
