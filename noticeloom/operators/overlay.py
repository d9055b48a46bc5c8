"""Edits over computed values: overlays, merges, differences and changes of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truthy(value: Column, kind: T.DataType = T.StringType()) -> Column:
    """Whether a value counts as given: not null, and not an empty string or list, zero or false. Structs and maps always count."""
    given = value.isNotNull()
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return given & (F.octet_length(value) > 0)
    if isinstance(kind, T.ArrayType):
        return given & (F.size(value) > 0)
    if isinstance(kind, T.BooleanType):
        return given & value
    if isinstance(kind, T.NumericType):
        return given & (value != 0)
    return given


def overlay_value(user: Column, server: Column, kind: T.DataType = T.StringType()) -> Column:
    """The user's value where it is given, else the server's."""
    return F.when(truthy(user, kind), user).otherwise(server)


def _fields(df: DataFrame, column: str) -> list[T.StructField]:
    return list(df.schema[column].dataType.fields)


def overlay_struct(df: DataFrame, user: str, server: str, name: str = "event") -> DataFrame:
    """df with a struct of each field's user value where given, else the server's."""
    own = {f.name for f in _fields(df, user)}
    parts = [(overlay_value(F.col(user)[f.name], F.col(server)[f.name], f.dataType) if f.name in own else F.col(server)[f.name]).alias(f.name) for f in _fields(df, server)]
    return df.withColumn(name, F.struct(*parts))


def merge_struct(df: DataFrame, user: str, server: str, name: str = "event") -> DataFrame:
    """Like overlay_struct, but an empty user value wins too: only null leaves the server's."""
    own = {f.name for f in _fields(df, user)}
    parts = [(F.coalesce(F.col(user)[f.name], F.col(server)[f.name]) if f.name in own else F.col(server)[f.name]).alias(f.name) for f in _fields(df, server)]
    return df.withColumn(name, F.struct(*parts))


def diff_value(edited: Column, original: Column, kind: T.DataType) -> Column:
    """What an edit changed: scalars and whole lists that differ; structs field by field."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*(diff_value(edited[f.name], original[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.when(~edited.eqNullSafe(original), inner)
    if isinstance(kind, T.MapType):
        return F.when(~F.to_json(edited).eqNullSafe(F.to_json(original)), edited)
    return F.when(~edited.eqNullSafe(original), edited)


def diff_struct(df: DataFrame, edited: str, original: str, name: str = "user_event") -> DataFrame:
    """df with the changes of an edited struct; without an original the edited struct is all change."""
    parts = [diff_value(F.col(edited)[f.name], F.col(original)[f.name], f.dataType).alias(f.name) for f in _fields(df, edited)]
    return df.withColumn(name, F.when(F.col(original).isNull(), F.col(edited)).otherwise(F.struct(*parts)))


def appended(values: Column, value: Column) -> Column:
    return F.array_append(F.coalesce(values, F.array()), value)


def removed_at(values: Column, index: int) -> Column:
    """A list without its entry at a place, counted from 0."""
    return F.filter(values, lambda x, i: i != index)


def without_keys(df: DataFrame, column: str, *names: str) -> DataFrame:
    return df.withColumn(column, F.col(column).dropFields(*names))


def is_json(text: Column) -> Column:
    """Whether a text is valid JSON."""
    return F.try_parse_json(text).isNotNull()


def json_field(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)
