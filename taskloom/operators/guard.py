"""Checks on submitted query texts before anybody runs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Messages of the checks.
EMPTY = "fn_execute_sql: empty SQL"
MULTIPLE = "fn_execute_sql: multiple statements not allowed"
NOT_SELECT = "fn_execute_sql: only SELECT allowed (got: "
NO_FROM = "fn_execute_sql: cannot parse FROM clause"
NOT_ALLOWED = "fn_execute_sql: view {} not in sandbox allowlist"


def stripped(sql: Column) -> Column:
    """Without line comments, then without block comments, then without spaces at either end."""
    return F.btrim(F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", ""), r"(?s)/\*.*?\*/", ""))


def first_table(sql: Column) -> Column:
    """Lower-case name after the first FROM; empty if there is none. Later FROMs are not looked at."""
    return F.lower(F.regexp_extract(sql, r"(?iU)FROM\s+([\w.]+)", 1))


def check_sql(requests: DataFrame, allowlist: DataFrame, text: str = "sql_text") -> DataFrame:
    """Add `table_name`, `verdict` and the error `message` (null when the verdict is ok)."""
    allowed = allowlist.select(F.lower("view_name").alias("table_name"), F.lit(True).alias("_allowed")).distinct()
    read = requests.withColumn("_sql", stripped(F.col(text)))
    read = read.withColumn("table_name", F.coalesce(first_table(F.col("_sql")), F.lit("")))
    judged = read.join(allowed, "table_name", "left")
    sql = F.col("_sql")
    verdict = (
        F.when(sql == "", "empty")
        .when(F.instr(sql, ";") > 0, "multi_statement")
        .when(~sql.rlike(r"(?i)^\s*SELECT\s"), "not_select")
        .when(F.col("table_name") == "", "no_from")
        .when(F.col("_allowed").isNull(), "not_allowlisted")
        .otherwise("ok")
    )
    before, after = NOT_ALLOWED.split("{}")
    message = (
        F.when(F.col("verdict") == "empty", EMPTY)
        .when(F.col("verdict") == "multi_statement", MULTIPLE)
        .when(F.col("verdict") == "not_select", F.concat(F.lit(NOT_SELECT), F.left(sql, F.lit(50)), F.lit(")")))
        .when(F.col("verdict") == "no_from", NO_FROM)
        .when(F.col("verdict") == "not_allowlisted", F.concat(F.lit(before), F.col("table_name"), F.lit(after)))
    )
    return judged.withColumn("verdict", verdict).withColumn("message", message).select(
        *requests.columns, "table_name", "verdict", "message"
    )
