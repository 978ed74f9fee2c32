"""Plans terms of the factor language onto a panel: Columns in as few stages as nested windows need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import known_at
from .language import PIT, Node, parse
from .rolling import MACROS, OPERATORS, T, Frame


class Planner:
    """Turns terms into Columns. A window can't stand in a window's argument, so such arguments become columns of a stage
    before. Equal terms are planned once, and all windows of a stage over one instrument share one shuffle and sort."""

    def __init__(self, frame: Frame) -> None:
        self.frame, self.stages, self.known = frame, [], {}

    def _staged(self, column: Column, stage: int) -> tuple[Column, bool, int]:
        while len(self.stages) <= stage:
            self.stages.append([])
        name = f"_s{stage}_{len(self.stages[stage])}"
        self.stages[stage].append(column.alias(name))
        return F.col(name), False, stage + 1

    def plan(self, node) -> tuple[Column, bool, int]:
        """(Column, whether it holds a window, the stage from which it can be computed)."""
        if not isinstance(node, Node):
            return node, False, 0
        if node.name == "field":
            return F.col(node.args[0]), False, 0
        if node not in self.known:
            if node.name in MACROS:
                self.known[node] = self.plan(MACROS[node.name](*node.args))
                return self.known[node]
            if node.name not in OPERATORS:
                raise ValueError(f"unknown operator {node.name}")
            op, args = OPERATORS[node.name], []
            for child in node.args:
                column, windowed, stage = self.plan(child)
                args.append(self._staged(column, stage) if op.window and windowed else (column, windowed, stage))
            column = op.build(self.frame, *(a[0] for a in args))
            self.known[node] = column, op.window or any(a[1] for a in args), max((a[2] for a in args), default=0)
        return self.known[node]


def _fields(term) -> set[str]:
    if not isinstance(term, Node):
        return set()
    return {term.args[0]} if term.name == "field" else set().union(*map(_fields, term.args), set())


def computed(panel: DataFrame, formulas: dict[str, str | Node], *, strict: bool = False, keep: tuple[str, ...] = ("instrument", "date"), facts: DataFrame | None = None) -> DataFrame:
    """keep and a column for each formula. A formula that is a plain number is that constant.

    A point-in-time field $$x is what is known of x at a row's date: of facts (field, instrument, period, obs_date, value, seq), the latest period
    observed by then in its latest revision. Without facts such a formula is refused.
    """
    planner = Planner(Frame(strict))
    terms = {name: parse(f, OPERATORS.keys() | MACROS.keys()) if isinstance(f, str) else f for name, f in formulas.items()}
    for name in sorted(f for t in terms.values() for f in _fields(t) if f.startswith(PIT)):
        if facts is None:
            raise ValueError(f"$${name[len(PIT):]} is a point-in-time field and needs facts")
        if name not in panel.columns:
            known = known_at(panel.select("instrument", "date"), facts.where(F.col("field") == name[len(PIT):]).drop("field"))
            panel = panel.join(known.select("instrument", "date", F.col("value").alias(name)), ["instrument", "date"], "left")
    columns = {name: planner.plan(t)[0] for name, t in terms.items()}
    df = panel.withColumn(T, F.row_number().over(Window.partitionBy("instrument").orderBy("date")))
    for stage in planner.stages:
        df = df.select("*", *stage)
    return df.select(*keep, *[(c if isinstance(c, Column) else F.lit(c)).alias(name) for name, c in columns.items()])
