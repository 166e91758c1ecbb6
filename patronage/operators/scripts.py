"""Jobs over tables of SQL scripts or other texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions.text import code_text, cte_names, referenced_tables, scanned_ctes, scanned_tables, without_comments


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path``, whole, as one row. A file without content gives none."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def sql_inventory(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """Tables, CTE names and clauses of each script, found by pattern.

    ``select_before_from`` says whether SELECT stands before the first FROM.
    """
    sql = F.col(text_col)
    upper = F.upper(sql)
    return texts.select(
        id_col,
        referenced_tables(sql).alias("referenced_tables"),
        cte_names(sql).alias("ctes"),
        upper.contains("GROUP BY").alias("has_group_by"),
        upper.contains("ORDER BY").alias("has_order_by"),
        upper.contains("OVER (").alias("has_window_function"),
        F.substring_index(upper, "FROM", 1).contains("SELECT").alias("select_before_from"),
    )


def scanned_references(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """Tables and CTEs of each script as its code refers to them: comments, literals and quoted names hold none, and a
    CTE is no table. A column of a table or CTE, and a function that stands after FROM, are none either."""
    code = texts.select(id_col, without_comments(F.col(text_col)).alias("code"))
    found = code.select(id_col, "code", scanned_ctes(F.col("code")).alias("scanned_ctes"))
    return found.select(id_col, scanned_tables(F.col("code"), F.col("scanned_ctes")).alias("scanned_tables"), "scanned_ctes")


def table_references(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per text and referenced table."""
    return texts.select(id_col, F.explode(referenced_tables(F.col(text_col))).alias("table_name"))


def cleaned_code(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    return texts.select(id_col, code_text(F.col(text_col)).alias("code"))
