"""Regressions and correlations of returns on those of a target instrument, over rolling windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def student_p(t: Column, df: int) -> Column:
    """Two-sided p-value of Student's t with a whole number of degrees of freedom, by the finite series in cos(atan(t / sqrt(df)))."""
    angle = F.atan(F.abs(t) / math.sqrt(df))
    sin, square = F.sin(angle), F.pow(F.cos(angle), 2)
    factors = [(k / (k + 1)) for k in range(1 if df % 2 == 0 else 2, df - 2, 2)]
    series = F.lit(1.0)
    for q in reversed(factors):
        series = 1 + F.lit(q) * square * series
    if df % 2 == 0:
        inside = sin * series
    else:
        inside = (angle + (sin * F.cos(angle) * series if df > 1 else F.lit(0.0))) * (2 / math.pi)
    return F.when(t.isNotNull(), F.greatest(1 - inside, F.lit(0.0)))


def paired_with_target(panel: DataFrame, target, n: int, value: str = "close") -> DataFrame:
    """(instrument, date, y, x): returns over n rows of each instrument and of the target on the same date, null where there is none."""
    w = Window.partitionBy("instrument").orderBy("date")
    rows = panel.select("instrument", "date", (F.try_divide(F.col(value).cast("double"), F.lag(value, n).over(w)) - 1).alias("y"))
    return rows.join(rows.where(F.col("instrument") == F.lit(target)).select("date", F.col("y").alias("x")), "date", "left").select("instrument", "date", "y", "x")


def rolling_regression(rows: DataFrame, n: int, y: str = "y", x: str = "x") -> DataFrame:
    """rows with alpha, beta, r_value, p_value and stderr of the least squares line of y on x over the last n rows (n > 2).

    All five are null unless n pairs are there and x changes. Where y doesn't change, r_value is 0.
    """
    if n < 3:
        raise ValueError("a regression needs three rows")
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    p, q = F.when(both, F.col(x)), F.when(both, F.col(y))
    w = Window.partitionBy("instrument").orderBy("date").rowsBetween(-(n - 1), 0)
    out = rows.withColumns({
        "_n": F.count(p).over(w), "_mx": F.avg(p).over(w), "_my": F.avg(q).over(w), "_xx": F.var_pop(p).over(w), "_yy": F.var_pop(q).over(w), "_xy": F.covar_pop(p, q).over(w),
    })
    ok = (F.col("_n") == n) & (F.col("_xx") > 0)
    r = F.when(F.col("_yy") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))))).otherwise(0.0)
    out = out.withColumns({"beta": F.when(ok, F.col("_xy") / F.col("_xx")), "r_value": F.when(ok, r)})
    t = F.col("r_value") * F.sqrt((n - 2) / ((1 - F.col("r_value") + 1e-20) * (1 + F.col("r_value") + 1e-20)))
    return out.withColumns({
        "alpha": F.col("_my") - F.col("beta") * F.col("_mx"), "p_value": student_p(t, n - 2),
        "stderr": F.sqrt((1 - F.col("r_value") * F.col("r_value")) * F.col("_yy") / F.col("_xx") / (n - 2)),
    }).drop("_n", "_mx", "_my", "_xx", "_yy", "_xy")
