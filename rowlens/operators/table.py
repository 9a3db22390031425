"""The table under analysis: named columns plus a row number, typed or all text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.functions import text
from rowlens.sources.rownum import ROW_NUMBER, is_small, number_file_rows, number_rows, spread
from rowlens.sources.scratch import materialize


@dataclass(frozen=True)
class ColumnRef:
    ordinal: int
    original_name: str
    internal_key: str
    field: str
    kind: str  # text | exact (rendered exactly as text) | date | double | skip


def internal_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_") or "column"


def name_columns(header: list[str], max_length: int | None = None) -> list[tuple[str, str, list[str]]]:
    """Display name, unique key and warning codes per header cell (a header is one short row).

    Names are kept whole unless `max_length` is given."""
    used: set[str] = set()
    out = []
    for ordinal, raw in enumerate(header):
        codes = []
        name = raw
        if not name:
            name = f"column_{ordinal}"
            codes.append("parsing.empty_column_name")
        if max_length and len(name) > max_length:
            name = name[:max_length]
            codes.append("parsing.column_name_truncated")
        base = key = internal_key(name)
        suffix = 2
        while key in used:
            key = f"{base}_{suffix}"
            suffix += 1
        if key != base:
            codes.append("parsing.duplicate_column_name")
        used.add(key)
        out.append((name, key, codes))
    return out


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, (T.IntegralType, T.DecimalType, T.BooleanType, T.TimestampType, T.TimestampNTZType)):
        return "exact"
    return "skip"


def _kept(df: DataFrame) -> DataFrame:
    """A small scan is spread over all cores and, as every operator reads the table anew, written once.

    Types and names that a written table cannot have are spread anew by each reader.
    """
    if not is_small(df):
        return df
    names = {f.name.lower() for f in df.schema.fields}
    if len(names) < len(df.columns) or any(_kind(f.dataType) == "skip" for f in df.schema.fields):
        return spread(df, True)
    return materialize(spread(df, True), "table")


class Table:
    """A DataFrame with a `row_number` column and the references of its data columns."""

    def __init__(self, df: DataFrame, columns: list[ColumnRef], facts: dict | None = None):
        self.df = df
        self.columns = columns
        self.facts = facts  # ingest facts, when the source recorded them
        self.stored: dict = {}  # intermediate tables several operators read

    @classmethod
    def from_dataframe(
        cls,
        df: DataFrame,
        *,
        row_number: Column | None = None,
        order_by: list | None = None,
        names: list[str] | None = None,
        facts: dict | None = None,
    ) -> Table:
        """Wrap a DataFrame.

        `row_number` is an existing dense 0-based position; otherwise `order_by` gives the row
        order; otherwise rows are numbered in file order (Parquet scans). `names` replaces the
        display names, which lets two columns share one.
        """
        fields = [f for f in df.schema.fields if f.name != ROW_NUMBER]
        header = names or [f.name for f in fields]
        columns = [
            ColumnRef(i, name, key, f.name, _kind(f.dataType))
            for i, (f, (name, key, _)) in enumerate(zip(fields, name_columns(header), strict=True))
        ]
        if row_number is not None:
            df = _kept(df.withColumn(ROW_NUMBER, row_number.cast("long")))
        elif ROW_NUMBER in df.columns:
            df = _kept(df)
        else:
            df = number_rows(df, order_by) if order_by else number_file_rows(df)
        return cls(df, columns, facts)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @cached_property
    def row_count(self) -> int:
        return self.df.count()

    @property
    def active(self) -> list[ColumnRef]:
        return [c for c in self.columns if c.kind != "skip"]

    def by_name(self, name: str) -> ColumnRef | None:
        return next((c for c in self.columns if c.original_name == name), None)

    def text(self, c: ColumnRef) -> Column:
        col = F.col(f"`{c.field}`")
        return col if c.kind == "text" else col.cast("string")

    def num(self, c: ColumnRef) -> Column:
        col = F.col(f"`{c.field}`")
        if c.kind == "double":
            return col.cast("double")
        if c.kind == "exact":
            return self.text(c).try_cast("double")
        return text.to_double(self.text(c))

    def day(self, c: ColumnRef) -> Column:
        col = F.col(f"`{c.field}`")
        return col if c.kind == "date" else text.iso_date(self.text(c))

    def missing(self, c: ColumnRef) -> Column:
        col = F.col(f"`{c.field}`")
        return text.is_missing(col) if c.kind == "text" else col.isNull()

    def blank(self, c: ColumnRef) -> Column:
        col = F.col(f"`{c.field}`")
        return text.is_blank(col) if c.kind == "text" else col.isNull()

    def all_blank(self) -> Column:
        return text.all_of([self.blank(c) for c in self.columns])

    def columns_frame(self) -> DataFrame:
        return self.spark.createDataFrame(
            [(c.ordinal, c.original_name, c.internal_key) for c in self.columns],
            "ordinal int, original_name string, internal_key string",
        )
