"""Aggregates over JSON columns, made of built-in ones."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolattice.functions import documents as D
from geolattice.functions.columns import non_empty


def first_not_null(value: Column, order: Column) -> Column:
    """First non-null value in the given order; without one the answer would depend on the plan."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def array_unique_merge(value: Column) -> Column:
    """Distinct members of all JSON arrays, sorted; null if there are none."""
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.from_json(non_empty(value), "array<string>")))))
    return F.when(F.size(merged) > 0, merged)


def json_min(value: Column) -> Column:
    """Least number of JSON scalars, null and empty ones apart."""
    return F.min(non_empty(value).try_cast("double"))


def json_max(value: Column) -> Column:
    return F.max(non_empty(value).try_cast("double"))


def leaf_rows(df: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """keys, path, value of every leaf of the documents."""
    @F.pandas_udf("array<struct<path:string,value:string>>")
    def rows(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else [(p, D.canonical(v)) for p, v in D.leaves(json.loads(t))])

    return df.select(*keys, F.explode(rows(F.col(json_col))).alias("leaf")).select(*keys, "leaf.path", "leaf.value")


def field_rows(df: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """keys, path, is_leaf, kind of every member of the documents."""
    @F.pandas_udf("array<struct<path:string,is_leaf:boolean,kind:string>>")
    def rows(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else D.paths(json.loads(t)))

    return df.select(*keys, F.explode(rows(F.col(json_col))).alias("f")).select(*keys, "f.*")


def common_paths(df: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """keys, paths: leaves that every document of a group has, with one value."""
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"))
    # count_distinct would expand each row; the least and greatest value tell as much.
    leaf = leaf_rows(df, json_col, *keys).groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo = hi")
    joined = leaf.join(total, list(keys)) if keys else leaf.crossJoin(total)
    return joined.filter("n = n_docs").groupBy(*keys).agg(F.array_sort(F.collect_list("path")).alias("paths"))
