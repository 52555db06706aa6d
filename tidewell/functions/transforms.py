"""User code in a pass: value and row transforms, generated expressions, hooks."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DELETE, OPERATION, ColumnMapping, Mapping


def map_values(changes: DataFrame, transforms: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Applies an expression to declared columns; deletes keep what they have. A transform may
    be built of Spark's functions or a pandas UDF; either way only its column is touched."""
    live = F.col(OPERATION) != DELETE
    each = {c: F.when(live, f(F.col(c))).otherwise(F.col(c)) for c, f in transforms.items()}
    return changes.withColumns(each)


def map_rows(changes: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rewrites or drops rows: any function of the DataFrame, mapInPandas included. The result
    must keep the columns."""
    done = transform(changes)
    lost = set(changes.columns) - set(done.columns)
    if lost:
        raise ValueError(f"a row transform must keep the columns {sorted(lost)}")
    return done.select(*changes.columns)


def dropped(before: DataFrame, after: DataFrame) -> int:
    """How many rows a transform dropped."""
    return before.count() - after.count()


def generated(mapping: Mapping, build: Callable[[ColumnMapping], str | None]) -> Mapping:
    """The mapping with transforms from a callable, for columns that have none of their own; a
    blank one leaves the column alone."""
    columns = []
    for c in mapping.columns:
        text = None if c.transform else build(c)
        columns.append(replace(c, transform=text) if text and text.strip() else c)
    return replace(mapping, columns=tuple(columns))


#: Where hooks of a pass run: around the staging of its rows and around their loading.
POINTS = ("before_stage", "after_stage", "before_load", "after_load")


@dataclass(frozen=True)
class Hook:
    """A step of the user's at a point of a pass; on_error is fail, or warn to go on."""

    run: Callable[[], Any]
    on_error: str = "fail"


def run_hooks(hooks: dict[str, list[Hook]], point: str) -> None:
    """Runs a point's hooks in their order."""
    unknown = set(hooks) - set(POINTS)
    if unknown:
        raise ValueError(f"unknown hook points: {sorted(unknown)}")
    for hook in hooks.get(point, []):
        try:
            hook.run()
        except Exception as error:
            if hook.on_error != "warn":
                raise
            warnings.warn(f"hook at {point} failed: {error}", stacklevel=2)


def render_hook(text: str, tables: dict[str, str]) -> str:
    """{{target}}, {{staging}}, {{source}} and the like as names; an unknown one is an error."""

    def name(found: re.Match) -> str:
        if found[1] not in tables:
            raise ValueError(f"a hook refers to {{{{{found[1]}}}}}, which this pass doesn't have")
        return tables[found[1]]

    return re.sub(r"\{\{(\w+)\}\}", name, text)


def run_hook(spark: SparkSession, text: str, tables: dict[str, str], arguments: dict | None = None, on_error: str = "fail") -> DataFrame | None:
    """Runs a hook's SQL; :name parameters are bound, not spliced in. on_error warn goes on."""
    try:
        return spark.sql(render_hook(text, tables), args=arguments or {})
    except Exception as error:
        if on_error != "warn":
            raise
        warnings.warn(f"hook failed: {error}", stacklevel=2)
        return None
