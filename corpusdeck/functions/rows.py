"""Rows out of arrays that are costly to make.

A plain explode lets the optimiser ask for non-empty arrays first and push that question, with the array's whole
expression, below everything it is made from: the array is then made twice, and helper columns are made anew
for each of their elements. The outer forms are asked nothing; the missing rows go afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, array: Column | str, *keep, pos: str = "ord", value: str = "x") -> DataFrame:
    """keep, the position (from 0) and the value of each element of an array."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def inlined(df: DataFrame, array: Column | str, *keep, key: str) -> DataFrame:
    """keep and the fields of each struct of an array; key is a field that is never null."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(key).isNotNull())
