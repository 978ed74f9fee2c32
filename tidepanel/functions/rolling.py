"""Operators of the factor language as Columns. Missing values are NULL; a result that needs more values is NULL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .language import Node

#: Row number of a row in its instrument, added to every panel before windows are taken.
T = "_t"


@dataclass(frozen=True)
class Frame:
    """Windows over a panel, and how many values a result needs: all N of a frame (strict) or one."""

    strict: bool = False
    by: tuple[str, ...] = ("instrument",)
    order: tuple[str, ...] = ("date",)

    @property
    def series(self):
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def last(self, n: int):
        """The last n rows; all rows so far for n = 0."""
        return self.series.rowsBetween(Window.unboundedPreceding if n == 0 else -(n - 1), 0)

    def next(self, n: int, wait: int = 1):
        return self.series.rowsBetween(wait, wait + n - 1)


@dataclass(frozen=True)
class Operator:
    build: Callable
    window: bool = False
    #: children that must be columns of an earlier stage since the operator frames what it computes of them
    doc: str = ""


OPERATORS: dict[str, Operator] = {}


def operator(name: str, window: bool = False):
    """Registers an operator: a function of the frame and the arguments' Columns (or numbers)."""

    def put(f: Callable) -> Callable:
        OPERATORS[name] = Operator(f, window, (f.__doc__ or "").strip())
        return f

    return put


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x) if isinstance(x, int) and not isinstance(x, bool) else x)


def _plain(name: str, f: Callable) -> None:
    OPERATORS[name] = Operator(lambda fr, *a: f(*map(_c, a)))


div = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
truth = lambda c, missing=False: F.coalesce(c, F.lit(missing))
both = lambda a, b, c: F.when(_c(a).isNotNull() & _c(b).isNotNull(), c)
num = lambda c: _c(c).cast("double")

for _name, _f in {
    "Add": lambda a, b: num(a) + num(b), "Sub": lambda a, b: num(a) - num(b), "Mul": lambda a, b: num(a) * num(b), "Div": div,
    "Mod": lambda a, b: F.when(num(b) != 0, F.pmod(num(a), num(b))), "Power": F.pow, "Neg": lambda a: -num(a),
    "Gt": lambda a, b: truth(num(a) > num(b)), "Ge": lambda a, b: truth(num(a) >= num(b)), "Lt": lambda a, b: truth(num(a) < num(b)),
    "Le": lambda a, b: truth(num(a) <= num(b)), "Eq": lambda a, b: truth(num(a) == num(b)), "Ne": lambda a, b: truth(num(a) != num(b), True),
    "And": lambda a, b: a & b, "Or": lambda a, b: a | b, "Not": lambda a: ~a,
    "Greater": lambda a, b: both(a, b, F.greatest(num(a), num(b))), "Less": lambda a, b: both(a, b, F.least(num(a), num(b))),
    "If": lambda c, a, b: F.when(truth(c.cast("boolean"), True), num(a)).otherwise(num(b)),
    "Abs": F.abs, "Sign": F.signum, "Log": lambda a: F.when(a > 0, F.ln(a)), "Log10": lambda a: F.when(a > 0, F.log10(a)),
    "Log1p": lambda a: F.when(a > -1, F.log1p(a)), "Exp": F.exp, "Expm1": F.expm1, "Sqrt": lambda a: F.when(a >= 0, F.sqrt(a)),
    "Sin": F.sin, "Cos": F.cos, "Tan": F.tan, "Arcsin": lambda a: F.when(F.abs(a) <= 1, F.asin(a)), "Arccos": lambda a: F.when(F.abs(a) <= 1, F.acos(a)),
    "Arctan": F.atan, "Sinh": F.sinh, "Cosh": F.cosh, "Tanh": F.tanh, "Arcsinh": F.asinh, "Arccosh": lambda a: F.when(a >= 1, F.acosh(a)),
    "Arctanh": lambda a: F.when(F.abs(a) < 1, F.atanh(a)), "Floor": lambda a: num(F.floor(a)), "IsInf": lambda a: truth(F.abs(num(a)) == float("inf")), "IsFinite": lambda a: truth((F.abs(num(a)) != float("inf")) & ~F.isnan(num(a))), "IsNull": lambda a: a.isNull(), "NotNull": lambda a: a.isNotNull(),
    "Fillna": lambda a, v: F.coalesce(num(a), num(v)), "Clip": lambda a, lo, hi: F.when(a.isNotNull(), F.least(F.greatest(num(a), num(lo)), num(hi))),
    "Where": lambda c, a: F.when(truth(c), num(a)), "Tri": lambda a: F.when(a, 1.0).when(~a, 0.0),
}.items():
    _plain(_name, _f)


def _guard(fr: Frame, x: Column, n: int, value: Column, least: int | None = None) -> Column:
    """value, if the frame holds enough values of x: least, else n in a strict frame and one otherwise."""
    need = least if least is not None else (max(n, 1) if fr.strict else 1)
    return F.when(F.count(x).over(fr.last(n)) >= need, value)


def _rolling(name: str, f: Callable[[Column], Column], least: int | None = None) -> None:
    def build(fr: Frame, x: Column, n: int) -> Column:
        return _guard(fr, x, n, f(num(x)).over(fr.last(n)), least)

    OPERATORS[name] = Operator(build, True)


for _name, _f in {"Mean": F.avg, "Sum": F.sum, "Max": F.max, "Min": F.min, "Std": F.stddev_samp, "Var": F.var_samp, "Std0": F.stddev_pop, "Prod": F.product}.items():
    _rolling(_name, _f)
_rolling("Med", lambda x: F.percentile(x, 0.5))


@operator("Quantile", True)
def _(fr, x, n, q):
    """Linear interpolation."""
    return _guard(fr, x, n, F.percentile(num(x), q).over(fr.last(n)))


@operator("Ref", True)
def _(fr, x, n):
    """n rows back; forward if n is negative; the first value of the series for 0 in the loose dialect."""
    if n == 0:
        return x if fr.strict else F.first(x).over(fr.series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.lag(x, n).over(fr.series) if n > 0 else F.lead(x, -n).over(fr.series)


@operator("Count", True)
def _(fr, x, n):
    return num(F.count(x).over(fr.last(n)))


@operator("Delta", True)
def _(fr, x, n):
    back = F.first(x).over(fr.series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if n == 0 else F.lag(x, n).over(fr.series)
    return num(x) - num(back)


@operator("Roc", True)
def _(fr, x, n):
    """x / x[n rows back] - 1."""
    return div(x, F.lag(x, n).over(fr.series)) - 1


@operator("Skew", True)
def _(fr, x, n):
    w = fr.last(n)
    k = num(F.count(x).over(w))
    return F.when((k >= 3) & (F.var_samp(num(x)).over(w) > 0), F.skewness(num(x)).over(w) * F.sqrt(k * (k - 1)) / (k - 2))


@operator("Kurt", True)
def _(fr, x, n):
    w = fr.last(n)
    k = num(F.count(x).over(w))
    return F.when((k >= 4) & (F.var_samp(num(x)).over(w) > 0), ((k + 1) * F.kurtosis(num(x)).over(w) + 6) * (k - 1) / ((k - 2) * (k - 3)))


def _extreme(sign: int):
    def build(fr, x, n):
        """1-based place of the first extreme value in the frame."""
        w = fr.last(n)
        at = F.max_by(F.col(T), F.when(x.isNotNull(), F.struct(sign * num(x), -F.col(T)))).over(w)
        return num(at - F.min(T).over(w) + 1)

    return build


OPERATORS["IdxMax"], OPERATORS["IdxMin"] = Operator(_extreme(1), True), Operator(_extreme(-1), True)


@operator("Mad", True)
def _(fr, x, n):
    """Mean absolute deviation from the frame's mean."""
    a = F.collect_list(num(x)).over(fr.last(n))
    m = F.avg(num(x)).over(fr.last(n))
    return _guard(fr, x, n, F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v - m)) / F.size(a))


@operator("Rank", True)
def _(fr, x, n):
    """Percent rank of the last value in the frame, ties averaged."""
    a = F.collect_list(num(x)).over(fr.last(n))
    low, same = F.size(F.filter(a, lambda v: v < num(x))), F.size(F.filter(a, lambda v: v == num(x)))
    return F.when(x.isNotNull(), _guard(fr, x, n, (low + (same + 1) / 2) / F.size(a)))


def _line(f: Callable) -> Callable:
    return lambda fr, x, n: F.when(F.count(x).over(fr.last(n)) >= 2, f(num(x), num(F.col(T)), fr.last(n)))


OPERATORS["Slope"] = Operator(_line(lambda x, t, w: F.regr_slope(x, t).over(w)), True)
OPERATORS["Rsquare"] = Operator(_line(lambda x, t, w: F.when(F.stddev_samp(x).over(w) > 2e-5, F.regr_r2(x, t).over(w))), True)
OPERATORS["Resi"] = Operator(_line(lambda x, t, w: x - (F.regr_slope(x, t).over(w) * t + F.regr_intercept(x, t).over(w))), True)


@operator("WMA", True)
def _(fr, x, n):
    """The weighted mean, weights 1 to the frame's rows, divided once more by the number of values."""
    w, t = fr.last(n), num(F.col(T))
    rows = num(F.count(F.lit(1)).over(w))
    total = F.sum(t * num(x)).over(w) - (F.min(t).over(w) - 1) * F.sum(num(x)).over(w)
    return F.when(F.count(x).over(w) > 0, div(total, rows * (rows + 1) / 2 * F.count(x).over(w)))


@operator("LinearWMA", True)
def _(fr, x, n):
    """The mean with weights 1 to n of a full frame."""
    w, t = fr.last(n), num(F.col(T))
    total = F.sum(t * num(x)).over(w) - (F.min(t).over(w) - 1) * F.sum(num(x)).over(w)
    return F.when(F.count(x).over(w) == n, total / (n * (n + 1) / 2))


@operator("FixedEWMA", True)
def _(fr, x, n, decay):
    """The mean of a full frame with weights decay ** age."""
    a = F.collect_list(num(x)).over(fr.last(n))
    weights = [decay ** (n - k) for k in range(n)]
    total = F.aggregate(F.zip_with(a, F.array(*map(F.lit, weights)), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.count(x).over(fr.last(n)) == n, total / sum(weights))


def _pair(f: Callable, least: int = 2) -> Callable:
    def build(fr, x, y, n):
        w = fr.last(n)
        p, q = both(x, y, num(x)), both(x, y, num(y))
        return F.when(F.count(p).over(w) >= least, f(p, q, w))

    return build


_flat = lambda p, q, w: (F.stddev_samp(p).over(w) > 2e-5) & (F.stddev_samp(q).over(w) > 2e-5)
OPERATORS["Corr"] = Operator(_pair(lambda p, q, w: F.when(_flat(p, q, w), div(F.covar_samp(p, q).over(w), F.stddev_samp(p).over(w) * F.stddev_samp(q).over(w)))), True)
OPERATORS["Cov"] = Operator(_pair(lambda p, q, w: F.covar_samp(p, q).over(w)), True)
OPERATORS["Beta"] = Operator(_pair(lambda p, q, w: div(F.covar_samp(p, q).over(w), F.var_samp(q).over(w))), True)
OPERATORS["Alpha"] = Operator(_pair(lambda p, q, w: F.regr_intercept(p, q).over(w)), True)


@operator("Spearman", True)
def _(fr, x, y, n):
    """Correlation of the ranks, ties averaged, that both have among the pairs of a full frame."""
    w = fr.last(n)
    a = F.collect_list(both(x, y, F.struct(num(x).alias("x"), num(y).alias("y")))).over(w)
    rank = lambda f: F.transform(a, lambda v: num(F.size(F.filter(a, lambda u: u[f] < v[f]))) + (F.size(F.filter(a, lambda u: u[f] == v[f])) + 1) / 2)
    # ranks of either side have the mean (n + 1) / 2
    mid, add = (n + 1) / 2, lambda p: F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
    cov = lambda p, q: add(F.zip_with(p, q, lambda u, v: (u - mid) * (v - mid)))
    p, q = rank("x"), rank("y")
    return F.when(F.size(a) == n, div(cov(p, q), F.sqrt(cov(p, p) * cov(q, q))))


@operator("FFill", True)
def _(fr, x):
    return F.last(x, ignorenulls=True).over(fr.series.rowsBetween(Window.unboundedPreceding, 0))


@operator("BFill", True)
def _(fr, x):
    return F.first(x, ignorenulls=True).over(fr.series.rowsBetween(0, Window.unboundedFollowing))


def _ahead(name: str, f: Callable[[Column], Column]) -> None:
    def build(fr, x, n, wait=1):
        """Over the next n rows after wait - 1 more; NULL where they run out."""
        w = fr.next(n, wait)
        return F.when(F.count(x).over(w) == n, f(num(x)).over(w))

    OPERATORS[name] = Operator(build, True)


for _name, _f in {"NextMean": F.avg, "NextStd": F.stddev_pop, "NextMin": F.min, "NextMax": F.max}.items():
    _ahead(_name, _f)


@operator("CrossedAbove", True)
def _(fr, a, b):
    """Where a is above b and wasn't a row ago, if it was below before."""
    above, below = truth(num(a) > num(b)), truth(num(a) < num(b))
    before = F.max(below).over(fr.series.rowsBetween(Window.unboundedPreceding, 0))
    return above & before & ~F.coalesce(F.lag(above).over(fr.series), F.lit(False))


@operator("CumSum", True)
def _(fr, x):
    return F.coalesce(F.sum(num(x)).over(fr.last(0)), F.lit(0.0))


@operator("CumProd", True)
def _(fr, x):
    return F.coalesce(F.product(num(x)).over(fr.last(0)), F.lit(1.0))


@operator("All", True)
def _(fr, x, n):
    """Whether x is true in all n rows of a full frame."""
    return (F.count(F.lit(1)).over(fr.last(n)) == n) & F.min(truth(x)).over(fr.last(n))


@operator("Any", True)
def _(fr, x, n):
    return F.max(truth(x)).over(fr.last(n))


@operator("AtLeastN", True)
def _(fr, x, n, k):
    return F.sum(truth(x).cast("int")).over(fr.last(n)) >= k


@operator("AllPresent", True)
def _(fr, x, n):
    return F.count(x).over(fr.last(n)) == n


# operators over the cross-section of a date: their windows are of a date's rows
def _day():
    return Window.partitionBy("date")




def _cross(name: str, f: Callable) -> None:
    OPERATORS[name] = Operator(lambda fr, x, *a: f(num(x), *a), True)


def _ranked(x: Column) -> Column:
    w = Window.partitionBy("date", x.isNull()).orderBy(x)
    return F.when(x.isNotNull(), F.rank().over(w) + (F.count(x).over(w.rangeBetween(0, 0)) - 1) / 2)


_cross("CsMean", lambda x: F.avg(x).over(_day()))
_cross("CsSum", lambda x: F.sum(x).over(_day()))
_cross("CsStd", lambda x: F.stddev_pop(x).over(_day()))
_cross("CsMax", lambda x: F.max(x).over(_day()))
_cross("CsMin", lambda x: F.min(x).over(_day()))
_cross("CsCount", lambda x: num(F.count(x).over(_day())))
_cross("CsMedian", lambda x: F.percentile(x, 0.5).over(_day()))
_cross("Demean", lambda x: x - F.avg(x).over(_day()))
_cross("ZScore", lambda x: div(x - F.avg(x).over(_day()), F.stddev_pop(x).over(_day())))
_cross("CsZScore", lambda x: div(x - F.avg(x).over(_day()), F.stddev_samp(x).over(_day())))
_cross("CsPctRank", lambda x: div(_ranked(x), F.count(x).over(_day())))
_cross("CsRankNorm", lambda x: (div(_ranked(x), F.count(x).over(_day())) - 0.5) * 3.46)
_cross("CsFill", lambda x: F.coalesce(x, F.avg(x).over(_day())))
_cross("CsOrdinal", lambda x: F.when(x.isNotNull(), num(F.row_number().over(Window.partitionBy("date", x.isNull()).orderBy(x, "instrument")))))
_cross("CsDense", lambda x: F.when(x.isNotNull(), num(F.dense_rank().over(Window.partitionBy("date", x.isNull()).orderBy(x)))))
_cross("CsMinRank", lambda x: F.when(x.isNotNull(), num(F.rank().over(Window.partitionBy("date", x.isNull()).orderBy(x)))))
_cross("CsMaxRank", lambda x: F.when(x.isNotNull(), num(F.count(x).over(Window.partitionBy("date", x.isNull()).orderBy(x).rangeBetween(Window.unboundedPreceding, 0)))))
_cross("Top", lambda x, n: truth(F.when(x.isNotNull(), F.row_number().over(Window.partitionBy("date", x.isNull()).orderBy(x.desc(), "instrument")) <= n)))
_cross("Bottom", lambda x, n: truth(F.when(x.isNotNull(), F.row_number().over(Window.partitionBy("date", x.isNull()).orderBy(x, "instrument")) <= n)))
_cross("PercentileBetween", lambda x, lo, hi: truth((x >= F.percentile(x, lo / 100).over(_day())) & (x <= F.percentile(x, hi / 100).over(_day()))))


@operator("Quantiles", True)
def _(fr, x, bins):
    """Label 0 to bins - 1 by linearly interpolated edges, closed on the right; -1 without a value."""
    edges = [F.percentile(num(x), k / bins).over(_day()) for k in range(1, bins)]
    label = sum(((num(x) > e).cast("int") for e in edges), F.lit(0))
    return num(F.when(x.isNotNull(), label).otherwise(-1))


#: Operators that are terms of others. A date's order statistics come from ranks and its deviations from a stage of their own, so
#: that every window is aggregated once for a date.
MACROS: dict[str, Callable] = {}


def macro(f: Callable) -> Callable:
    MACROS[f.__name__] = f
    return f


@macro
def Winsorize(x, low, high):
    """Clamps to the order statistics int(low * n) and n - 1 - int((1 - high) * n) of the date."""
    n, rank = Node("CsCount", (x,)), Node("CsOrdinal", (x,))
    least = Node("CsMin", (Node("Where", (rank > Node("Floor", (n * low,)), x)),))
    most = Node("CsMax", (Node("Where", (rank <= n - Node("Floor", (n * (1 - high),)), x)),))
    return Node("Clip", (x, least, most))


@macro
def RobustZ(x):
    """(x - median) / (1.4826 * median absolute deviation) of the date, clipped to +-3."""
    off = x - Node("CsMedian", (x,))
    return Node("Clip", (off / (Node("CsMedian", (Node("Abs", (off,)),)) * 1.4826), -3.0, 3.0))


def _in_day():
    return Window.partitionBy("instrument", F.to_date("date"))


@operator("DayLast", True)
def _(fr, x):
    """The day's last value; of equal times the greatest."""
    return F.max_by(num(x), F.when(x.isNotNull(), F.struct(F.col("date"), num(x)))).over(_in_day())


@operator("DayCumsum", True)
def _(fr, x, start="9:30", end="14:59"):
    """The day's sum so far of the values from start to end, ends (minutes) included; 0 outside."""
    minute = lambda s: int(s.split(":")[0]) * 60 + int(s.split(":")[1])
    now = F.hour("date") * 60 + F.minute("date")
    within = now.between(minute(start), minute(end))
    sums = F.sum(F.when(within, num(x))).over(_in_day().orderBy("date").rangeBetween(Window.unboundedPreceding, 0))
    return F.when(~within, 0.0).otherwise(F.when(x.isNotNull(), sums))


@operator("Date", True)
def _(fr, x):
    """The row's day, as days since 1970."""
    return num(F.unix_date(F.to_date("date")))


@operator("Cut", True)
def _(fr, x, left, right):
    """Without the series' first left and last -right rows, which become missing."""
    rows = F.count(F.lit(1)).over(fr.series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when((F.col(T) > left) & (F.col(T) <= rows + right), num(x))


@operator("ChangeInstrument", True)
def _(fr, instrument, x):
    """The same date's value of a fixed instrument."""
    return F.max(F.when(F.col("instrument").cast("string") == F.lit(str(instrument)), num(x))).over(_day())


@operator("Mask", True)
def _(fr, x, instrument):
    """ChangeInstrument with its arguments the other way round."""
    return F.max(F.when(F.col("instrument").cast("string") == F.lit(str(instrument)), num(x))).over(_day())
