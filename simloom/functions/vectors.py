"""Vector columns: schemas, factories, text forms and conversions.

A sparse vector is (vector_id, size, indices, values) with strictly rising indices; a dense one is an array of doubles.
Text form one is ``(id,size,[i,...],[v,...])``, form two ``((size,[i,...],[v,...]),id)``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARSE = T.StructType(
    [
        T.StructField("vector_id", T.LongType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("indices", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)
FORM_ONE = r"^\(\s*(-?\d+)\s*,\s*(\d+)\s*,\s*\[(.*?)\]\s*,\s*\[(.*?)\]\s*\)\s*$"
FORM_TWO = r"^\(\(\s*(\d+)\s*,\s*\[(.*?)\]\s*,\s*\[(.*?)\]\s*\)\s*,\s*(-?\d+)\s*\)\s*$"


def _numbers(text: Column, kind: str) -> Column:
    return F.when(F.trim(text) == "", F.array().cast(f"array<{kind}>")).otherwise(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast(kind)))


def _parsed(line: Column, pattern: str, order: tuple[int, int, int, int]) -> Column:
    group = [F.regexp_extract(line, pattern, k) for k in order]
    fields = F.struct(
        group[0].try_cast("long").alias("vector_id"), group[1].try_cast("int").alias("size"),
        _numbers(group[2], "int").alias("indices"), _numbers(group[3], "double").alias("values"),
    )
    return F.when(line.rlike(pattern), fields)


def parse_form_one(line: Column) -> Column:
    """Text form one as a struct; null if the line is not of that form. Empty lists are allowed."""
    return _parsed(line, FORM_ONE, (1, 2, 3, 4))


def parse_form_two(line: Column) -> Column:
    return _parsed(line, FORM_TWO, (4, 1, 2, 3))


def parse(line: Column) -> Column:
    """Either text form; null if the line has neither."""
    return F.coalesce(parse_form_one(line), parse_form_two(line))


def _list_text(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: x.cast("string")), ","), F.lit("]"))


def format_form_one(vector_id: Column, size: Column, indices: Column, values: Column) -> Column:
    return F.concat(F.lit("("), vector_id.cast("string"), F.lit(","), size.cast("string"), F.lit(","), _list_text(indices), F.lit(","), _list_text(values), F.lit(")"))


def format_form_two(vector_id: Column, size: Column, indices: Column, values: Column) -> Column:
    return F.concat(F.lit("(("), size.cast("string"), F.lit(","), _list_text(indices), F.lit(","), _list_text(values), F.lit("),"), vector_id.cast("string"), F.lit(")"))


def valid(size: Column, indices: Column, values: Column) -> Column:
    """Whether a sparse vector has as many values as indices, and rising indices within its size."""
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(indices) - 1, F.lit(1))), lambda k: F.coalesce(F.get(indices, k - 1) < F.get(indices, k), F.lit(True)))
    inside = F.forall(indices, lambda i: (i >= 0) & (i < size))
    return (F.size(indices) == F.size(values)) & rising & inside


def checked(size: Column, indices: Column, values: Column) -> Column:
    """The values, with an error at run time where the vector is not valid."""
    return F.when(F.assert_true(valid(size, indices, values), "not a valid sparse vector").isNull(), values)


def from_pairs(size: Column, pairs: Column) -> Column:
    """A struct (size, indices, values) from an array of structs (i, v) in any order; repeated or outside indices are errors."""
    ordered = F.array_sort(pairs)
    indices, values = F.transform(ordered, lambda p: p["i"].cast("int")), F.transform(ordered, lambda p: p["v"].cast("double"))
    return F.struct(size.cast("int").alias("size"), indices.alias("indices"), checked(size, indices, values).alias("values"))


def dense_to_sparse(values: Column) -> Column:
    """A struct (size, indices, values) of the non-zero components."""
    pairs = F.transform(values, lambda x, k: F.struct(k.alias("i"), x.cast("double").alias("v")))
    kept = F.filter(pairs, lambda p: p["v"] != 0)
    return F.struct(F.size(values).alias("size"), F.transform(kept, lambda p: p["i"]).alias("indices"), F.transform(kept, lambda p: p["v"]).alias("values"))


def to_dense(size: Column, indices: Column, values: Column) -> Column:
    entries = F.map_from_arrays(indices, values)
    return F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.coalesce(F.try_element_at(entries, k), F.lit(0.0)))


def zeros(size: int) -> Column:
    return F.array_repeat(F.lit(0.0), size)


def normalize(values: Column) -> Column:
    """Values over their Euclidean norm; a zero vector stays as it is."""
    total = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(values, lambda x: F.when(total > 0, x.cast("double") / total).otherwise(x.cast("double")))


def same_vector(dense_a: Column, dense_b: Column) -> Column:
    """Equality of the dense forms, whatever ids and representation."""
    return dense_a.eqNullSafe(dense_b)


def make_vector(vector_id: int, value, size: int | None = None) -> tuple[int, int, list[int], list[float]]:
    """A row of SPARSE from text, (size, indices, values), pairs (with size), a numpy array or a sequence of numbers."""
    if isinstance(value, str):
        import re

        one, two = re.match(FORM_ONE, value), re.match(FORM_TWO, value)
        if not one and not two:
            raise ValueError(f"not a vector: {value[:60]!r}")
        n, i, v = (one[2], one[3], one[4]) if one else (two[1], two[2], two[3])
        return make_vector(int(one[1] if one else two[4]), (int(n), [int(x) for x in i.split(",") if x.strip()], [float(x) for x in v.split(",") if x.strip()]))
    if size is not None:
        pairs = sorted(value.items() if isinstance(value, dict) else value)
        value = (size, [int(i) for i, _ in pairs], [float(v) for _, v in pairs])
    if isinstance(value, tuple) and len(value) == 3 and isinstance(value[1], Iterable):
        n, i, v = int(value[0]), list(value[1]), [float(x) for x in value[2]]
        if len(i) != len(v) or any(a >= b for a, b in zip(i, i[1:], strict=False)) or i and not 0 <= i[0] <= i[-1] < n:
            raise ValueError("indices must rise, lie within the size, and match the values")
        return vector_id, n, i, v
    dense = np.asarray(value, float)
    if dense.ndim != 1:
        raise ValueError("not a vector")
    there = np.flatnonzero(dense)
    return vector_id, len(dense), there.tolist(), dense[there].tolist()


def to_bytes(vector_id: int, size: int, indices: list[int], values: list[float]) -> bytes:
    """Binary form: id, size, number of entries, indices, values; big-endian."""
    n = len(indices)
    return struct.pack(f">iii{n}i{n}d", vector_id, size, n, *indices, *values)


def from_bytes(data: bytes) -> tuple[int, int, list[int], list[float]]:
    vector_id, size, n = struct.unpack_from(">iii", data)
    rest = struct.unpack_from(f">{n}i{n}d", data, 12)
    return vector_id, size, list(rest[:n]), list(rest[n:])
