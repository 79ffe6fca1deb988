"""Arrow types of this engine's types."""

from __future__ import annotations


def arrow_type(ddl: str):
    """The Arrow type that a DDL type is sent as."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T.StructType.fromDDL(f"x {ddl}")[0].dataType)
