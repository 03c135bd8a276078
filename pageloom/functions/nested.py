"""Nested Arrow arrays as Python objects, by leaves: to_pylist() makes a scalar of each value, which takes longer than kernels on small pages."""

from __future__ import annotations

import pyarrow as pa


def plain(a: pa.Array) -> list:
    """What a.to_pylist() returns."""
    if not len(a):
        return []  # Spark sends no offsets for it
    if pa.types.is_list(a.type):
        at = a.offsets.to_numpy().tolist()
        items = plain(a.values.slice(at[0], at[-1] - at[0]))
        out = [items[x - at[0] : y - at[0]] for x, y in zip(at, at[1:], strict=False)]
    elif pa.types.is_struct(a.type) and a.type.num_fields:
        names = [a.type.field(i).name for i in range(a.type.num_fields)]
        out = [dict(zip(names, v, strict=True)) for v in zip(*(plain(a.field(i)) for i in range(a.type.num_fields)), strict=True)]
    elif not a.null_count and (pa.types.is_integer(a.type) or pa.types.is_float64(a.type)):
        return a.to_numpy().tolist()
    else:
        return a.to_pylist()
    return [x if ok else None for x, ok in zip(out, a.is_valid().to_pylist(), strict=True)] if a.null_count else out
