"""Carry a row's other columns through an operator without meeting its names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_REST = "_other_columns"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(rows: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct."""
    rest = [F.col(_quoted(c)) for c in rows.columns if c not in needed]
    return rows.select(*needed, (F.struct(*rest) if rest else F.lit(None)).alias(_REST))


def unpacked(rows: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `like` from packed rows; `changed` replaces some, in the type they had."""
    rest = rows.schema[_REST].dataType
    carried = set(rest.fieldNames()) if isinstance(rest, StructType) else set()
    out = []
    for field in like.schema.fields:
        if field.name in changed:
            column = changed[field.name].cast(field.dataType)
        elif field.name in carried:  # whatever columns of that name the operator has added
            column = F.col(_REST).getField(field.name)
        else:
            column = F.col(field.name)
        out.append(column.alias(field.name))
    return rows.select(*out)
