"""Typed staging: a value that its target column can't hold is refused, not bent to fit.

Each staged column is assigned to the stored type of its target column, as Spark's ANSI store
assignment does, but for every row at once, so that what is refused can be counted and shown. A value
is refused if it has no counterpart in the type (a text that is no number), is beyond its range or precision,
would lose a fraction, is longer than a char or varchar column, or is null where the column
takes none. Nothing is read twice: the refusals are a column of the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import quoted

#: Why the values of a row don't fit: an array of (column, value, reason), empty where they do.
REFUSED = "__refused"
NO_TYPE, TOO_LONG, INEXACT, MISSING = "not of the type", "too long", "inexact", "null"
#: What every text that Spark casts to a whole number looks like; it strips spaces and control characters.
WHOLE = r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$"
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def plain(kind: T.DataType) -> T.DataType:
    """The type that holds a column's values: varchar and char are texts."""
    return T.StringType() if isinstance(kind, (T.VarcharType, T.CharType)) else kind


def assigned(value: Column, given: T.DataType, kind: T.DataType) -> Column:
    """The value in the type, or null if it has no counterpart there."""
    if given == plain(kind):
        return value
    if isinstance(given, T.StringType) and not isinstance(plain(kind), (T.StringType, T.BinaryType)):
        value = F.trim(value)  # an empty text is a value, too, and of no other type
        if isinstance(kind, T.IntegralType):
            given = T.LongType()
            value = F.when(value.rlike(WHOLE), value).try_cast(given)
    if isinstance(given, T.IntegralType) and isinstance(kind, T.IntegralType):
        return _narrowed(value, given, kind)
    return value.try_cast(plain(kind))


def _narrowed(value: Column, given: T.DataType, kind: T.DataType) -> Column:
    """The whole number in the type, or null. try_cast raises and catches an exception for each value
    that doesn't fit, which takes far longer than to compare it with the type's ends."""
    if _BITS[type(kind)] < _BITS[type(given)]:
        most = 1 << (_BITS[type(kind)] - 1)
        value = F.when(value.between(-most, most - 1), value)
    return value.try_cast(kind)


def _exact(value: Column, given: T.DataType, kind: T.DataType) -> Column:
    """False where the assigned number isn't the given one any more."""
    number = lambda t: isinstance(t, T.NumericType)
    if number(given) and number(kind) and not (isinstance(given, T.IntegralType) and isinstance(kind, T.IntegralType)):
        back = assigned(value, given, kind).try_cast(given)
        return back.eqNullSafe(value) if isinstance(kind, (T.IntegralType, T.DecimalType)) else F.lit(True)
    if isinstance(given, T.StringType) and isinstance(kind, T.DecimalType):
        exact = F.trim(value).try_cast(T.DecimalType(38, 18))
        return F.coalesce(assigned(value, given, kind).cast(T.DecimalType(38, 18)) == exact, F.lit(True))
    return F.lit(True)


def refusal(name: str, given: T.DataType, field: T.StructField) -> Column:
    """Why a value doesn't fit its column, or null."""
    value, kind = F.col(quoted(name)), field.dataType
    there, got = value.isNotNull(), assigned(value, given, kind)
    reason = F.when(there & got.isNull(), NO_TYPE)
    if isinstance(kind, (T.VarcharType, T.CharType)):
        reason = reason.when(F.length(got) > kind.length, TOO_LONG)
    reason = reason.when(there & ~_exact(value, given, kind), INEXACT)
    return reason if field.nullable else reason.when(~there, MISSING)


def typed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows in the target's types, with REFUSED. Columns that the schema hasn't stay as they are; those
    that rows hasn't are left out, or refused in every row if they must not be null."""
    known = {f.name: f for f in schema}
    kind = "array<struct<column:string,value:string,reason:string>>"
    one = lambda c, value, reason: F.array(F.struct(F.lit(c).alias("column"), value.cast("string").alias("value"), reason.alias("reason"))).cast(kind)
    none = F.array().cast(kind)
    every = [(c, refusal(c, rows.schema[c].dataType, known[c])) for c in rows.columns if c in known]
    found = [F.when(r.isNotNull(), one(c, F.col(quoted(c)), r)).otherwise(none) for c, r in every]
    found += [one(f.name, F.lit(None), F.lit(MISSING)) for f in schema if not f.nullable and f.name not in rows.columns]
    # joined, as a filter with a lambda isn't compiled, nor is anything below it, and evaluates each expression anew
    refused = F.concat(none, *found).alias(REFUSED)
    columns = [
        assigned(F.col(quoted(c)), rows.schema[c].dataType, known[c].dataType).alias(c) if c in known else F.col(quoted(c)) for c in rows.columns
    ]
    return rows.select(*columns, refused)


def split(rows: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows that fit, typed; and each refusal: the row's columns as they came, column, value, reason."""
    given = [F.col(quoted(c)).alias(f"__given_{i}") for i, c in enumerate(rows.columns)]
    both = typed(rows.select("*", *given), schema)
    good = both.filter(F.size(REFUSED) == 0).select(*[quoted(c) for c in rows.columns])
    back = [F.col(f"__given_{i}").alias(c) for i, c in enumerate(rows.columns)]
    return good, both.filter(F.size(REFUSED) > 0).select(F.struct(*back).alias("row"), F.inline(REFUSED))


def refusals(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """How many values of each column are refused, and why: column, reason, values."""
    # from inline(REFUSED) Spark would infer a filter, in which all of REFUSED is computed a second time
    found = typed(rows, schema).select(F.inline(F.arrays_zip(F.col(f"{REFUSED}.column"), F.col(f"{REFUSED}.reason"))))
    return found.groupBy("column", "reason").agg(F.count("*").alias("values"))


def strict(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows in the target's types, in whose plan a value that doesn't fit is an error that names it."""
    first = F.element_at(REFUSED, 1)
    said = F.concat(F.lit("column "), first["column"], F.lit(" can't hold "), F.coalesce(first["value"], F.lit("null")), F.lit(": "), first["reason"])
    passes = F.when(F.size(REFUSED) == 0, F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
    return typed(rows, schema).filter(passes).drop(REFUSED)
