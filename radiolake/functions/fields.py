"""Reading open-ended PDU records: nested paths, aliases, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def has_path(schema: T.StructType, path: str) -> bool:
    head, _, rest = path.partition(".")
    for f in schema.fields:
        if f.name == head:
            if not rest:
                return True
            return isinstance(f.dataType, T.StructType) and has_path(f.dataType, rest)
    return False


def field(df: DataFrame, path: str, dtype: str = "string", default=None) -> Column:
    """``path`` of ``df`` as ``dtype``.

    A leaf of ``extra`` that the schema does not list is looked up in ``extra_json``;
    what is absent or null becomes ``default``.
    """
    if has_path(df.schema, path):
        col = F.col(path)
        if dtype:
            col = col.cast(dtype)
    elif path.startswith("extra.") and "extra_json" in df.columns:
        col = F.get_json_object("extra_json", "$." + path[len("extra."):]).cast(dtype)
    else:
        col = F.lit(None).cast(dtype)
    return col if default is None else F.coalesce(col, F.lit(default).cast(dtype))


def first_field(df: DataFrame, names: list[str], dtype: str) -> Column:
    """First non-null of several alias columns; columns the frame lacks are skipped."""
    present = [F.col(n).cast(dtype) for n in names if has_path(df.schema, n)]
    return F.coalesce(*present) if present else F.lit(None).cast(dtype)


def offset_hz(df: DataFrame) -> Column:
    """Carrier offset under any of its three spellings."""
    return first_field(df, ["fo_hz", "_fo_hz", "x_fo_hz"], "double")


def nonempty(col: Column) -> Column:
    return F.when(F.length(col) > 0, col)


def round_half_up(col: Column) -> Column:
    """Round half away from zero to a whole BIGINT."""
    return F.round(col).cast("bigint")
