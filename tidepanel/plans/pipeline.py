"""Lazy pipelines: named terms and a screen over one panel, computed together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import Node, parse
from ..functions.planner import computed
from ..functions.rolling import OPERATORS


class Pipeline:
    """Columns (formulas or terms) and an optional screen (a boolean term). Nothing is computed before run().

    All terms go through one plan, so that equal sub-terms are computed once and one shuffle serves all windows over instruments.
    The screen drops rows of the result, never rows that a window or a cross-section needs.
    """

    def __init__(self, columns: dict[str, str | Node] | None = None, screen: str | Node | None = None) -> None:
        self.columns, self.screen = dict(columns or {}), screen

    def add(self, name: str, term: str | Node) -> Pipeline:
        if name in self.columns:
            raise ValueError(f"{name} is a column already")
        self.columns[name] = term
        return self

    def remove(self, name: str) -> Node | str:
        return self.columns.pop(name)

    def set_screen(self, term: str | Node) -> Pipeline:
        self.screen = term
        return self

    def fields(self) -> set[str]:
        """The panel's columns that the terms read."""
        found, queue = set(), [parse(t, set(OPERATORS)) if isinstance(t, str) else t for t in [*self.columns.values(), *([self.screen] if self.screen is not None else [])]]
        while queue:
            node = queue.pop()
            if isinstance(node, Node):
                found |= {node.args[0]} if node.name == "field" else set()
                queue += node.children
        return found

    def run(self, panel: DataFrame, start=None, end=None, *, strict: bool = True) -> DataFrame:
        """(instrument, date, columns) from start to end; dates before start feed the windows."""
        terms = dict(self.columns) | ({"_screen": self.screen} if self.screen is not None else {})
        out = computed(panel.select("instrument", "date", *sorted(self.fields())), terms, strict=strict)
        if self.screen is not None:
            out = out.where("_screen").drop("_screen")
        if start is not None:
            out = out.where(F.col("date") >= F.lit(start))
        return out if end is None else out.where(F.col("date") <= F.lit(end))


def matches(label: Column, *, eq=None, startswith=None, endswith=None, contains=None, regex=None, among=None) -> Column:
    """A filter of a classifier's labels; a missing label is false. regex is anchored at the start."""
    tests = [
        label == eq if eq is not None else None, label.startswith(startswith) if startswith is not None else None, label.endswith(endswith) if endswith is not None else None,
        label.contains(contains) if contains is not None else None, label.rlike(f"^(?:{regex})") if regex is not None else None, label.isin(list(among)) if among is not None else None,
    ]
    found = F.lit(True)
    for t in tests:
        if t is not None:
            found = found & t
    return F.coalesce(found, F.lit(False))


def grouped(df: DataFrame, value: str, group: str, how: str) -> DataFrame:
    """df with value_by_group: demeaned or z-scored (how) within the groups of each date."""
    w, v = Window.partitionBy("date", group), F.col(value)
    x = v - F.avg(v).over(w)
    return df.withColumn("value_by_group", x if how == "demean" else F.try_divide(x, F.stddev_pop(v).over(w)))


def peer_count(df: DataFrame, group: str) -> DataFrame:
    return df.withColumn("peer_count", F.when(F.col(group).isNotNull(), F.count("*").over(Window.partitionBy("date", group))))


def downsampled(df: DataFrame, value: str, unit: str) -> DataFrame:
    """value as of the first date of its week, month, quarter or year, held until the next one."""
    w = Window.partitionBy("instrument", F.date_trunc(unit, "date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"{value}_{unit}", F.first(value).over(w))
