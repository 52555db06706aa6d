"""Expressions that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DELETE, INSERT, UPDATE

TOKEN = "{{column}}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def transformed(reference: str, transform: str | None) -> Column:
    """The SQL transform with its token replaced by the reference, or the column itself."""
    return F.expr(transform.replace(TOKEN, reference)) if transform else F.expr(reference)


def differs(left: str, right: str, columns: list[str]) -> Column:
    """True where any of the columns differs, null being a value; false without columns."""
    each = [~F.col(f"{left}.{quoted(c)}").eqNullSafe(F.col(f"{right}.{quoted(c)}")) for c in columns]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Plain equality of all keys: a null key meets nothing."""
    each = [F.col(f"{left}.{quoted(c)}") == F.col(f"{right}.{quoted(c)}") for c in keys]
    return reduce(lambda a, b: a & b, each)


def operation_code(value: Column, codes: dict[int, str] | None = None) -> Column:
    """Change log codes as I, U and D: 1 delete, 2 insert, 4 update. A before image (3) or
    anything else is an error."""
    codes = codes or {1: DELETE, 2: INSERT, 4: UPDATE}
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    bad = F.raise_error(F.concat(F.lit("unknown change operation "), F.coalesce(value.cast("string"), F.lit("null"))))
    return F.coalesce(F.element_at(table, value), bad.cast("string"))


def ordering(*parts: Column, width: int = 20) -> Column:
    """Numbers as one text of fixed width per number, whose order is theirs."""
    return F.concat(*[F.lpad(F.hex(p), width, "0") for p in parts])

