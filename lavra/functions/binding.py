"""A name for a column expression, names for columns, and values of a batch one by one."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_slices(values: pa.Array, of, kind: pa.DataType, size: int = 64) -> pa.Array:
    """of(value) of each value that isn't null; no more than `size` results are Python objects at once."""
    result = lambda v: of(v.as_py()) if v.is_valid else None
    parts = [pa.array([result(v) for v in values.slice(at, size)], kind) for at in range(0, len(values), size)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it in any case of letters."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        found.append(name)
    return found
