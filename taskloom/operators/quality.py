"""Constraint checks: one row per violation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CHECKS, FOREIGN_KEYS, KEYS, UNIQUES, ForeignKey, Tables, Unique
from ..session import stage


def _key_text(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _violations(df: DataFrame, table: str, rule: Column, key: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), rule.alias("rule"), key.alias("row_key"))


def _row_rules(t: Tables, table: str) -> DataFrame:
    """All row-level rules of a table in one scan."""
    broken = [F.when(F.expr(c.violated), F.lit(c.rule)) for c in CHECKS if c.table == table]
    rows = t[table].withColumn("_rule", F.explode(F.array_compact(F.array(*broken))))
    return _violations(rows, table, F.col("_rule"), _key_text(KEYS[table]))


def _duplicates(t: Tables, unique: Unique) -> DataFrame:
    columns = list(unique.columns)
    twice = t[unique.table].where(unique.where).dropna(subset=columns).groupBy(*columns).count().where("count > 1")
    return _violations(twice, unique.table, F.lit(f"unique {','.join(columns)}"), _key_text(columns))


def _orphans(t: Tables, fk: ForeignKey) -> DataFrame:
    """Rows that point nowhere; a hot reference is split by the skew handling of the join."""
    parents = t[fk.parent].select(F.col(fk.parent_column).alias(fk.column))
    rows = t[fk.table].dropna(subset=[fk.column]).join(parents, fk.column, "left_anti")
    return _violations(rows, fk.table, F.lit(f"{fk.column} references {fk.parent}"), _key_text(KEYS[fk.table]))


def validate_tables(t: Tables, tables: Sequence[str] | None = None) -> DataFrame:
    """Violations of domains, ranges, not-null, uniqueness and references, over all tables or the named ones."""
    chosen = list(tables) if tables is not None else list(KEYS)
    # Every rule reads the same staged copies: a table is built once, however many constraints it has.
    needed = {*chosen, *[fk.parent for fk in FOREIGN_KEYS if fk.table in chosen]}
    t = t.replace(**{name: stage(t[name]) for name in sorted(needed)})
    parts = [_row_rules(t, name) for name in chosen]
    parts += [_duplicates(t, u) for u in UNIQUES if u.table in chosen]
    parts += [_orphans(t, fk) for fk in FOREIGN_KEYS if fk.table in chosen]
    return reduce(DataFrame.unionByName, parts)
