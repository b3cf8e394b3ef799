"""Rules applied while a plan is put together, where Catalyst has none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond so many ids a membership test becomes a join with a table of them.
INLINE_IDS = 1000
#: A table of this many rows of ids is small enough to send to every executor.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint, only where the known number of rows allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def counted(df: DataFrame) -> DataFrame:
    """A broadcast hint, only where a count of the rows shows that it is small."""
    return small(df, df.limit(BROADCAST_ROWS + 1).count())


def partitions(df: DataFrame, each: int = 500_000) -> int:
    """How many partitions give each about ``each`` of the rows, and every core one: so a task's memory does not grow with the table. Counts the rows, which suits stored tables."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each))


def keep_ids(df: DataFrame, col: str, ids: Sequence | DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose ``col`` is (not) among ``ids``. Null never matches; negated, null rows stay (an anti join, not NOT IN)."""
    how = "left_anti" if negate else "left_semi"
    if isinstance(ids, DataFrame):
        other = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
        return df.join(other, df[col] == other["__id"], how)
    ids = list(dict.fromkeys(ids))
    if len(ids) <= INLINE_IDS:
        hit = F.col(col).isin(ids)
        return df.where(~hit | F.col(col).isNull()) if negate else df.where(hit)
    other = df.sparkSession.createDataFrame([(i,) for i in ids], f"__id {df.schema[col].dataType.simpleString()}")
    return df.join(small(other, len(ids)), df[col] == other["__id"], how)


def axis_predicate(col: str, keep: Sequence[int], universe: int) -> Column | None:
    """The shape of a membership test on a sorted key: nothing, a range, a range with few gaps, or a list.

    ``keep``: ids out of 1 .. universe. None for "all"; lists beyond INLINE_IDS are left to keep_ids().
    """
    own = sorted(set(keep))
    if not own:
        return F.lit(False)
    if len(own) == universe and own[0] == 1 and own[-1] == universe:
        return None
    span = own[-1] - own[0] + 1
    inside = F.col(col).between(own[0], own[-1])
    if span == len(own):
        return inside
    gaps = sorted(set(range(own[0], own[-1] + 1)) - set(own)) if span - len(own) <= INLINE_IDS else None
    if gaps is not None and len(gaps) < len(own):
        return inside & ~F.col(col).isin(gaps)
    return inside & F.col(col).isin(own)


def inside_box(x: Column, y: Column, box: tuple[float, float, float, float], inclusive: Sequence[bool] = (True, True, True, True)) -> Column:
    """xmin, xmax, ymin, ymax; ``inclusive``: bottom, left, top, right. Plain comparisons, so they reach the Parquet scan."""
    xmin, xmax, ymin, ymax = map(float, box)
    bottom, left, top, right = inclusive
    return (x >= xmin if left else x > xmin) & (x <= xmax if right else x < xmax) & (y >= ymin if bottom else y > ymin) & (y <= ymax if top else y < ymax)


def half_planes(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Inside a convex polygon, its edges included, whichever way its corners turn."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, [*corners[1:], corners[0]], strict=True))
    own = list(corners) if area >= 0 else list(corners)[::-1]
    out = F.lit(True)
    for (x0, y0), (x1, y1) in zip(own, [*own[1:], own[0]], strict=True):
        nx, ny = -(y1 - y0), x1 - x0
        out = out & (x * nx + y * ny >= nx * x0 + ny * y0)
    return out


def intersect_boxes(a: tuple | None, b: tuple | None) -> tuple:
    """The common part of two extents; an error when there is none."""
    if a is None or b is None:
        return tuple(a or b)
    out = (max(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), min(a[3], b[3]))
    if out[0] > out[1] or out[2] > out[3]:
        raise ValueError("the extents do not meet")
    return out


def tiles_meeting(plan: Sequence[tuple[int, float, float, float, float]], box: tuple[float, float, float, float]) -> list[int]:
    """Indexes of the tiles (index, xmin, xmax, ymin, ymax) that a box touches: a partition filter."""
    return [t for t, x0, x1, y0, y1 in plan if x0 <= box[1] and x1 >= box[0] and y0 <= box[3] and y1 >= box[2]]
