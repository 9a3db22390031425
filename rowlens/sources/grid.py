"""Workbook cells as rows (SRC-09..11): a long table of cells becomes the sheet's grid.

cells(sheet, row, col, type, raw): `row` counts from 1, `col` from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.operators.table import ColumnRef, Table, name_columns
from rowlens.sources.rownum import ROW_NUMBER


BROADCAST_BYTES = 64 << 20


def decode_cells(cells: DataFrame, shared_strings: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """SRC-10: cell text by type. Shared strings are joined by index, broadcast up to a size in bytes."""
    strings = shared_strings.select("index", "string")
    size = strings.agg(F.sum(F.coalesce(F.octet_length("string"), F.lit(0)) + 32)).first()[0] or 0
    if size <= broadcast_bytes:
        strings = F.broadcast(strings)
    index = F.when(F.col("type") == "s", F.col("raw").try_cast("bigint"))
    joined = cells.withColumn("_index", index).join(strings, F.col("_index") == F.col("index"), "left")
    value = (
        F.when(F.col("type") == "s", F.col("string"))
        .when((F.col("type") == "b") & (F.col("raw") == "1"), "TRUE")
        .when((F.col("type") == "b") & (F.col("raw") == "0"), "FALSE")
        .otherwise(F.col("raw"))
    )
    return joined.select(
        "sheet",
        "row",
        "col",
        F.nullif(value, F.lit("")).alias("value"),
        (F.col("type") == "e").alias("is_error"),
        F.coalesce(F.col("type") == "f", F.lit(False)).alias("is_unresolved_formula"),
    )


def sheet_shapes(decoded: DataFrame) -> DataFrame:
    """SRC-11: header row, column count and data rows of every sheet.

    The header is the first row with a value; blank rows between data rows count, trailing
    blank rows do not.
    """
    filled = decoded.where(F.col("value").isNotNull())
    spans = filled.groupBy("sheet").agg(
        F.min("row").alias("header_row"), F.max("row").alias("last_row")
    )
    header = (
        filled.join(spans.select("sheet", F.col("header_row").alias("row")), ["sheet", "row"])
        .groupBy("sheet")
        .agg((F.max("col") + 1).alias("column_count"))
    )
    return spans.join(header, "sheet").select(
        "sheet",
        "header_row",
        "column_count",
        (F.col("last_row") - F.col("header_row")).alias("row_count"),
    )


def choose_sheet(sheets: list[tuple[str, bool]], requested: str | None = None) -> str:
    """SRC-11: a requested sheet must exist; otherwise exactly one sheet must be visible."""
    if requested is not None:
        if requested not in [name for name, _ in sheets]:
            raise ValueError(f"there is no worksheet {requested!r}")
        return requested
    visible = [name for name, shown in sheets if shown]
    if len(visible) != 1:
        raise ValueError("choose a worksheet")
    return visible[0]


def sheet_rows(decoded: DataFrame, sheet: str) -> tuple[Table, DataFrame]:
    """SRC-09: one sheet as a text table, and its ragged-row warnings.

    Row numbers follow from the sheet's own row index, so nothing is sorted; rows no cell belongs
    to are filled in from the range of data rows.
    """
    mine = decoded.where(F.col("sheet") == sheet)
    shape = sheet_shapes(mine).first()
    if shape is None:
        raise ValueError(f"worksheet {sheet!r} has no row with a value")
    width, header_row, count = shape["column_count"], shape["header_row"], shape["row_count"]
    names = [""] * width
    for r in mine.where((F.col("row") == header_row) & F.col("value").isNotNull()).select("col", "value").collect():
        names[r["col"]] = r["value"]
    described = name_columns(names)
    body = mine.where(F.col("value").isNotNull() & (F.col("row") > header_row)).withColumn(
        ROW_NUMBER, (F.col("row") - header_row - 1).cast("bigint")
    )
    grid = (
        body.where(F.col("col") < width)
        .groupBy(ROW_NUMBER)
        .agg(*[F.max(F.when(F.col("col") == i, F.col("value"))).alias(key) for i, (_, key, _) in enumerate(described)])
    )
    spark = decoded.sparkSession
    all_rows = spark.range(count).select(F.col("id").alias(ROW_NUMBER))
    ragged = body.where(F.col("col") >= width).select(ROW_NUMBER).distinct()
    columns = [ColumnRef(i, name, key, key, "text") for i, (name, key, _) in enumerate(described)]
    cells = mine.agg(
        F.count_if("is_error").alias("errors"), F.count_if("is_unresolved_formula").alias("formulas")
    ).first()
    unnamed = [i for i, n in enumerate(names) if not n]
    facts = {
        "row_count": count,
        "column_count": width,
        "unnamed_column_count": len(unnamed),
        "unnamed_columns": unnamed,
        "ragged_row_count": ragged.count(),
        "ragged_rows": ragged,
        "formula_without_cached_value_cell_count": cells["formulas"],
        "error_value_cell_count": cells["errors"],
    }
    warnings = ragged.select(F.lit("parsing.ragged_row").alias("code"), ROW_NUMBER)
    return Table(all_rows.join(grid, ROW_NUMBER, "left"), columns, facts), warnings
