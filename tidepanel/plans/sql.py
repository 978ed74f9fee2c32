"""DuckDB SQL of formulas, written apart from the Columns, against which these are held."""

from __future__ import annotations

from ..functions.language import Node, parse

S = "PARTITION BY instrument ORDER BY date"
D = "PARTITION BY date"


def _last(n: int) -> str:
    return f"OVER ({S} ROWS BETWEEN {'UNBOUNDED' if n == 0 else n - 1} PRECEDING AND CURRENT ROW)"


def _guarded(f: str):
    def build(strict, x, n, *more):
        need = max(n, 1) if strict else 1
        return f"CASE WHEN count({x}) {_last(n)} >= {need} THEN {f.format(x=x, w=_last(n), n=n, q=more[0] if more else '')} END"

    return build


def _framed(f: str):
    return lambda strict, x, n, *more: f.format(x=x, w=_last(n), n=n, k=more[0] if more else "")


def _paired(f: str):
    def build(strict, x, y, n):
        p, q = (f"(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {v} END)" for v in (x, y))
        return f"CASE WHEN count({p}) {_last(n)} >= 2 THEN {f.format(p=p, q=q, w=_last(n))} END"

    return build


def _ahead(f: str):
    def build(strict, x, n, wait=1):
        w = f"OVER ({S} ROWS BETWEEN {wait} FOLLOWING AND {wait + n - 1} FOLLOWING)"
        return f"CASE WHEN count({x}) {w} = {n} THEN {f}({x}) {w} END"

    return build


def _ewma(strict, x, n, decay):
    terms = [f"{decay ** k!r} * lag({x}, {k}) OVER ({S})" if k else f"{x}" for k in range(n)]
    return f"({' + '.join(terms)}) / {sum(decay**k for k in range(n))!r}"


def _ref(strict, x, n):
    if n == 0:
        return x if strict else f"first_value({x}) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"{'lag' if n > 0 else 'lead'}({x}, {abs(n)}) OVER ({S})"


def _true(s: str, missing: str = "FALSE"):
    return lambda strict, a, b: f"coalesce({a} {s} {b}, {missing})"


def _infix(s: str):
    return lambda strict, a, b: f"({a} {s} {b})"


def _call(f: str, test: str = ""):
    return lambda strict, a: f"CASE WHEN {test.format(a)} THEN {f}({a}) END" if test else f"{f}({a})"


_RANK = "(rank() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x}) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0)"
_of = lambda f: lambda strict, x, *a: f.format(x=x, D=D, a=a[0] if a else "", b=a[1] if len(a) > 1 else "", R=_RANK.format(x=x))
_present = lambda f: _of("CASE WHEN {x} IS NOT NULL THEN " + f + " END")

#: operator -> (function of the dialect and the arguments' SQL, whether it is a window)
SQL: dict[str, tuple] = {
    "Add": (_infix("+"), False), "Sub": (_infix("-"), False), "Mul": (_infix("*"), False), "Div": (lambda s, a, b: f"({a} / nullif(CAST({b} AS DOUBLE), 0))", False),
    "Mod": (lambda s, a, b: f"(({a} % nullif({b}, 0)) + {b}) % nullif({b}, 0)", False), "Power": (lambda s, a, b: f"pow({a}, {b})", False), "Neg": (lambda s, a: f"(-{a})", False),
    "Gt": (_true(">"), False), "Ge": (_true(">="), False), "Lt": (_true("<"), False), "Le": (_true("<="), False), "Eq": (_true("="), False), "Ne": (_true("<>", "TRUE"), False),
    "And": (_infix("AND"), False), "Or": (_infix("OR"), False), "Not": (lambda s, a: f"(NOT {a})", False),
    "Greater": (lambda s, a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END", False),
    "Less": (lambda s, a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END", False),
    "If": (lambda s, c, a, b: f"CASE WHEN coalesce({c}, TRUE) THEN CAST({a} AS DOUBLE) ELSE {b} END", False),
    "Abs": (_call("abs"), False), "Sign": (_call("sign"), False), "Log": (_call("ln", "{} > 0"), False), "Log10": (_call("log10", "{} > 0"), False),
    "Log1p": (lambda s, a: f"CASE WHEN {a} > -1 THEN ln(1 + {a}) END", False), "Exp": (_call("exp"), False), "Expm1": (lambda s, a: f"(exp({a}) - 1)", False),
    "Sqrt": (_call("sqrt", "{} >= 0"), False), "Sin": (_call("sin"), False), "Cos": (_call("cos"), False), "Tan": (_call("tan"), False), "Arcsin": (_call("asin", "abs({}) <= 1"), False),
    "Arccos": (_call("acos", "abs({}) <= 1"), False), "Arctan": (_call("atan"), False), "Sinh": (lambda s, a: f"((exp({a}) - exp(-{a})) / 2)", False),
    "Cosh": (lambda s, a: f"((exp({a}) + exp(-{a})) / 2)", False), "Tanh": (lambda s, a: f"(1 - 2 / (exp(2 * {a}) + 1))", False), "Arcsinh": (lambda s, a: f"ln({a} + sqrt({a} * {a} + 1))", False),
    "Arccosh": (lambda s, a: f"CASE WHEN {a} >= 1 THEN ln({a} + sqrt({a} * {a} - 1)) END", False), "Arctanh": (lambda s, a: f"CASE WHEN abs({a}) < 1 THEN 0.5 * ln((1 + {a}) / (1 - {a})) END", False),
    "IsNull": (lambda s, a: f"({a} IS NULL)", False), "NotNull": (lambda s, a: f"({a} IS NOT NULL)", False), "Fillna": (lambda s, a, v: f"coalesce({a}, {v})", False),
    "Clip": (lambda s, a, lo, hi: f"CASE WHEN {a} IS NOT NULL THEN least(greatest({a}, {lo}), {hi}) END", False), "Where": (lambda s, c, a: f"CASE WHEN {c} THEN CAST({a} AS DOUBLE) END", False),
    "Tri": (lambda s, a: f"CASE WHEN {a} THEN 1.0 WHEN NOT {a} THEN 0.0 END", False),
    "Mean": (_guarded("avg({x}) {w}"), True), "Sum": (_guarded("sum({x}) {w}"), True), "Max": (_guarded("max({x}) {w}"), True), "Min": (_guarded("min({x}) {w}"), True),
    "Std": (_guarded("stddev_samp({x}) {w}"), True), "Var": (_guarded("var_samp({x}) {w}"), True), "Std0": (_guarded("stddev_pop({x}) {w}"), True), "Prod": (_guarded("product({x}) {w}"), True),
    "Med": (_guarded("median({x}) {w}"), True), "Quantile": (_guarded("quantile_cont({x}, {q}) {w}"), True), "Ref": (_ref, True), "Count": (_framed("CAST(count({x}) {w} AS DOUBLE)"), True),
    "Delta": (lambda s, x, n: f"({x} - {_ref(False, x, n)})", True), "Roc": (lambda s, x, n: f"({x} / nullif({_ref(False, x, n)}, 0) - 1)", True),
    "Skew": (_framed("CASE WHEN count({x}) {w} >= 3 AND var_samp({x}) {w} > 0 THEN skewness({x}) {w} END"), True),
    "Kurt": (_framed("CASE WHEN count({x}) {w} >= 4 AND var_samp({x}) {w} > 0 THEN kurtosis({x}) {w} END"), True),
    "IdxMax": (_framed("CAST(list_position(list({x}) {w}, max({x}) {w}) AS DOUBLE)"), True), "IdxMin": (_framed("CAST(list_position(list({x}) {w}, min({x}) {w}) AS DOUBLE)"), True),
    "Mad": (_guarded("list_avg(list_transform(list({x}) {w}, lambda v: abs(v - list_avg(list({x}) {w}))))"), True),
    "Rank": (_guarded("(len(list_filter(list({x}) {w}, lambda v: v < {x})) + (len(list_filter(list({x}) {w}, lambda v: v = {x})) + 1) / 2.0) / len(list({x}) {w})"), True),
    "Slope": (_framed("CASE WHEN count({x}) {w} >= 2 THEN regr_slope({x}, t) {w} END"), True),
    "Rsquare": (_framed("CASE WHEN count({x}) {w} >= 2 AND stddev_samp({x}) {w} > 2e-5 THEN regr_r2({x}, t) {w} END"), True),
    "Resi": (_framed("CASE WHEN count({x}) {w} >= 2 THEN {x} - (regr_slope({x}, t) {w} * t + regr_intercept({x}, t) {w}) END"), True),
    "WMA": (_framed("(sum(t * {x}) {w} - (min(t) {w} - 1) * sum({x}) {w}) / nullif(count(*) {w} * (count(*) {w} + 1) / 2.0 * count({x}) {w}, 0)"), True),
    "LinearWMA": (_framed("CASE WHEN count({x}) {w} = {n} THEN (sum(t * {x}) {w} - (min(t) {w} - 1) * sum({x}) {w}) / ({n} * ({n} + 1) / 2.0) END"), True), "FixedEWMA": (_ewma, True),
    "Corr": (_paired("CASE WHEN stddev_samp({p}) {w} > 2e-5 AND stddev_samp({q}) {w} > 2e-5 THEN corr({p}, {q}) {w} END"), True), "Cov": (_paired("covar_samp({p}, {q}) {w}"), True),
    "Beta": (_paired("covar_samp({p}, {q}) {w} / nullif(var_samp({q}) {w}, 0)"), True), "Alpha": (_paired("regr_intercept({p}, {q}) {w}"), True),
    "FFill": (lambda s, x: f"last_value({x} IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", True),
    "BFill": (lambda s, x: f"first_value({x} IGNORE NULLS) OVER ({S} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", True),
    "NextMean": (_ahead("avg"), True), "NextStd": (_ahead("stddev_pop"), True), "NextMin": (_ahead("min"), True), "NextMax": (_ahead("max"), True),
    "CrossedAbove": (lambda s, a, b: f"(coalesce({a} > {b}, FALSE) AND bool_or(coalesce({a} < {b}, FALSE)) {_last(0)} AND NOT coalesce(lag(coalesce({a} > {b}, FALSE)) OVER ({S}), FALSE))", True),
    "CumSum": (lambda s, x: f"coalesce(sum({x}) {_last(0)}, 0)", True), "CumProd": (lambda s, x: f"coalesce(product({x}) {_last(0)}, 1)", True),
    "All": (_framed("(count(*) {w} = {n} AND bool_and(coalesce({x}, FALSE)) {w})"), True), "Any": (_framed("bool_or(coalesce({x}, FALSE)) {w}"), True),
    "AtLeastN": (_framed("(sum(CAST(coalesce({x}, FALSE) AS INT)) {w} >= {k})"), True), "AllPresent": (_framed("(count({x}) {w} = {n})"), True),
    "CsMean": (_of("avg({x}) OVER ({D})"), True), "CsSum": (_of("sum({x}) OVER ({D})"), True), "CsStd": (_of("stddev_pop({x}) OVER ({D})"), True), "CsMax": (_of("max({x}) OVER ({D})"), True),
    "CsMin": (_of("min({x}) OVER ({D})"), True), "CsCount": (_of("CAST(count({x}) OVER ({D}) AS DOUBLE)"), True), "CsMedian": (_of("median({x}) OVER ({D})"), True), "Demean": (_of("({x} - avg({x}) OVER ({D}))"), True),
    "ZScore": (_of("({x} - avg({x}) OVER ({D})) / nullif(stddev_pop({x}) OVER ({D}), 0)"), True), "CsZScore": (_of("({x} - avg({x}) OVER ({D})) / nullif(stddev_samp({x}) OVER ({D}), 0)"), True),
    "CsPctRank": (_present("{R} / count({x}) OVER ({D})"), True), "CsRankNorm": (_present("({R} / count({x}) OVER ({D}) - 0.5) * 3.46"), True), "CsFill": (_of("coalesce({x}, avg({x}) OVER ({D}))"), True),
    "CsOrdinal": (_present("CAST(row_number() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x}, instrument) AS DOUBLE)"), True),
    "CsDense": (_present("CAST(dense_rank() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x}) AS DOUBLE)"), True), "CsMinRank": (_present("CAST(rank() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x}) AS DOUBLE)"), True),
    "CsMaxRank": (_present("CAST(count({x}) OVER (PARTITION BY date ORDER BY {x}) AS DOUBLE)"), True),
    "Top": (_of("({x} IS NOT NULL AND row_number() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x} DESC, instrument) <= {a})"), True),
    "Bottom": (_of("({x} IS NOT NULL AND row_number() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x}, instrument) <= {a})"), True),
    "PercentileBetween": (_of("coalesce({x} >= quantile_cont({x}, {a} / 100.0) OVER ({D}) AND {x} <= quantile_cont({x}, {b} / 100.0) OVER ({D}), FALSE)"), True),
    "Winsorize": (_present("least(greatest({x}, list_sort(list({x}) FILTER ({x} IS NOT NULL) OVER ({D}))[CAST(floor({a} * count({x}) OVER ({D})) AS INT) + 1]), list_sort(list({x}) FILTER ({x} IS NOT NULL) OVER ({D}))[CAST(count({x}) OVER ({D}) - floor((1 - {b}) * count({x}) OVER ({D})) AS INT)])"), True),
    "Quantiles": (lambda s, x, bins: f"CAST(CASE WHEN {x} IS NULL THEN -1 ELSE " + " + ".join(f"CAST({x} > quantile_cont({x}, {k / bins!r}) OVER ({D}) AS INT)" for k in range(1, bins)) + " END AS DOUBLE)", True),
    "RobustZ": (_present("least(greatest(({x} - median({x}) OVER ({D})) / nullif(1.4826 * list_median(list_transform(list({x}) FILTER ({x} IS NOT NULL) OVER ({D}), lambda v: abs(v - median({x}) OVER ({D})))), 0), -3), 3)"), True),
}


class _Query:
    def __init__(self, strict: bool) -> None:
        self.strict, self.stages, self.known = strict, [], {}

    def _staged(self, sql: str, stage: int) -> tuple[str, bool, int]:
        while len(self.stages) <= stage:
            self.stages.append([])
        name = f"s{stage}_{len(self.stages[stage])}"
        self.stages[stage].append(f"{sql} AS {name}")
        return name, False, stage + 1

    def plan(self, node) -> tuple:
        if not isinstance(node, Node):
            return node, False, 0
        if node.name == "field":
            return node.args[0], False, 0
        if node not in self.known:
            build, window = SQL[node.name]
            args = []
            for child in node.args:
                sql, windowed, stage = self.plan(child)
                # any argument that isn't a name is staged, which keeps repeated arguments short
                name = isinstance(sql, str) and window and not sql.isidentifier()
                args.append(self._staged(sql, stage) if name else (sql, windowed, stage))
            self.known[node] = build(self.strict, *(a[0] for a in args)), window or any(a[1] for a in args), max((a[2] for a in args), default=0)
        return self.known[node]


def formula_sql(panel: str, formulas: dict[str, str | Node], *, strict: bool = False, rounded: int | None = 6) -> str:
    """SQL that gives instrument, date and a column for each formula over a panel's SQL."""
    query, out = _Query(strict), []
    for name, f in formulas.items():
        sql, _, stage = query.plan(parse(f) if isinstance(f, str) else f)
        out.append((name, sql))
    text = f"WITH p AS ({panel}), p0 AS (SELECT *, row_number() OVER ({S}) AS t FROM p)"
    for k, stage in enumerate(query.stages):
        text += f", p{k + 1} AS (SELECT *, {', '.join(stage)} FROM p{k})"
    return text + f" SELECT instrument, date, {', '.join(f'{s} AS {n}' for n, s in out)} FROM p{len(query.stages)}"
