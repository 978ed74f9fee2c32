"""Named features, labels, factors and indicators as formulas."""

from __future__ import annotations

KBAR = {
    "KMID": "($close - $open) / $open", "KLEN": "($high - $low) / $open", "KMID2": "($close - $open) / ($high - $low + 1e-12)",
    "KUP": "($high - Greater($open, $close)) / $open", "KUP2": "($high - Greater($open, $close)) / ($high - $low + 1e-12)",
    "KLOW": "(Less($open, $close) - $low) / $open", "KLOW2": "(Less($open, $close) - $low) / ($high - $low + 1e-12)",
    "KSFT": "(2 * $close - $high - $low) / $open", "KSFT2": "(2 * $close - $high - $low) / ($high - $low + 1e-12)",
}
#: The registry of the core language; strict frames. Like those of the wide set, fixed values.
CORE = {k: KBAR[k] for k in ("KMID", "KLEN", "KMID2", "KUP", "KLOW", "KSFT")} | {
    "ROC5": "Ref($close, 5) / $close", "ROC10": "Ref($close, 10) / $close", "MA5": "Mean($close, 5) / $close - 1", "MA10": "Mean($close, 10) / $close - 1",
    "STD5": "Std($close, 5) / $close", "VMA10": "Mean($volume, 10) / ($volume + 1e-12) - 1", "RSV5": "($close - Min($low, 5)) / (Max($high, 5) - Min($low, 5) + 1e-12)",
}
LABELS = {f"label_{n}d": f"Ref($close, -{n + 1}) / Ref($close, -1) - 1" for n in (1, 5, 10, 20)}

#: Families of the wide feature set by window d; loose frames.
FAMILIES = {
    "ROC": "Ref($close, {d}) / $close", "MA": "Mean($close, {d}) / $close", "STD": "Std($close, {d}) / $close", "BETA": "Slope($close, {d}) / $close",
    "RSQR": "Rsquare($close, {d})", "RESI": "Resi($close, {d}) / $close", "MAX": "Max($high, {d}) / $close", "MIN": "Min($low, {d}) / $close",
    "QTLU": "Quantile($close, {d}, 0.8) / $close", "QTLD": "Quantile($close, {d}, 0.2) / $close", "RANK": "Rank($close, {d})",
    "RSV": "($close - Min($low, {d})) / (Max($high, {d}) - Min($low, {d}) + 1e-12)", "IMAX": "IdxMax($high, {d}) / {d}", "IMIN": "IdxMin($low, {d}) / {d}",
    "IMXD": "(IdxMax($high, {d}) - IdxMin($low, {d})) / {d}", "CORR": "Corr($close, Log($volume + 1), {d})",
    "CORD": "Corr($close / Ref($close, 1), Log($volume / Ref($volume, 1) + 1), {d})",
    "CNTP": "Mean(Tri($close > Ref($close, 1)), {d})", "CNTN": "Mean(Tri($close < Ref($close, 1)), {d})",
    "CNTD": "Mean(Tri($close > Ref($close, 1)), {d}) - Mean(Tri($close < Ref($close, 1)), {d})",
    "SUMP": "Sum(Greater($close - Ref($close, 1), 0), {d}) / (Sum(Abs($close - Ref($close, 1)), {d}) + 1e-12)",
    "SUMN": "Sum(Greater(Ref($close, 1) - $close, 0), {d}) / (Sum(Abs($close - Ref($close, 1)), {d}) + 1e-12)",
    "SUMD": "(Sum(Greater($close - Ref($close, 1), 0), {d}) - Sum(Greater(Ref($close, 1) - $close, 0), {d})) / (Sum(Abs($close - Ref($close, 1)), {d}) + 1e-12)",
    "VMA": "Mean($volume, {d}) / ($volume + 1e-12)", "VSTD": "Std($volume, {d}) / ($volume + 1e-12)",
    "WVMA": "Std(Abs($close / Ref($close, 1) - 1) * $volume, {d}) / (Mean(Abs($close / Ref($close, 1) - 1) * $volume, {d}) + 1e-12)",
    "VSUMP": "Sum(Greater($volume - Ref($volume, 1), 0), {d}) / (Sum(Abs($volume - Ref($volume, 1)), {d}) + 1e-12)",
    "VSUMN": "Sum(Greater(Ref($volume, 1) - $volume, 0), {d}) / (Sum(Abs($volume - Ref($volume, 1)), {d}) + 1e-12)",
    "VSUMD": "(Sum(Greater($volume - Ref($volume, 1), 0), {d}) - Sum(Greater(Ref($volume, 1) - $volume, 0), {d})) / (Sum(Abs($volume - Ref($volume, 1)), {d}) + 1e-12)",
}
WINDOWS = (5, 10, 20, 30, 60)


def wide_features(windows=WINDOWS) -> dict[str, str]:
    """9 k-bar, 4 price and 29 families of rolling features: 158 columns for the five standard windows."""
    found = dict(KBAR) | {f"{f.upper()}0": f"${f} / $close" for f in ("open", "high", "low", "vwap")}
    return found | {f"{name}{d}": f.format(d=d) for name, f in FAMILIES.items() for d in windows}


def lag_features(lags: int = 60) -> dict[str, str]:
    """The lags of prices over the last close and of volumes over the last volume: 360 columns for 60 lags."""
    found = {f"{f.upper()}{k}": (f"Ref(${f}, {k}) / $close" if k else f"${f} / $close") for f in ("close", "open", "high", "low", "vwap") for k in range(lags - 1, -1, -1)}
    return found | {f"VOLUME{k}": (f"Ref($volume, {k}) / ($volume + 1e-12)" if k else "$volume / ($volume + 1e-12)") for k in range(lags - 1, -1, -1)}


_UP, _DOWN = "Greater(Delta($close, 1), 0)", "Greater(-Delta($close, 1), 0)"
_TR = "Greater($high - $low, Greater(Fillna(Abs($high - Ref($close, 1)), 0), Fillna(Abs($low - Ref($close, 1)), 0)))"
#: Technical indicators on simple moving averages with full frames; strict.
INDICATORS = {
    "ma": {"ma": "Mean($close, 10)"}, "mstd": {"mstd": "Std0($close, 10)"},
    "bb": {"middle": "Mean($close, 20)", "upper": "Mean($close, 20) + 2 * Std0($close, 20)", "lower": "Mean($close, 20) - 2 * Std0($close, 20)",
           "percent_b": "($close - (Mean($close, 20) - 2 * Std0($close, 20))) / (4 * Std0($close, 20))", "bandwidth": "4 * Std0($close, 20) / Mean($close, 20)"},
    "rsi": {"rsi": f"100 - 100 / (1 + Mean({_UP}, 14) / Mean({_DOWN}, 14))"},
    "stoch": {"percent_k": "100 * ($close - Min($low, 14)) / (Max($high, 14) - Min($low, 14))", "percent_d": "Mean(100 * ($close - Min($low, 14)) / (Max($high, 14) - Min($low, 14)), 3)"},
    "macd": {"macd": "Mean($close, 12) - Mean($close, 26)", "signal": "Mean(Mean($close, 12) - Mean($close, 26), 9)", "hist": "Mean($close, 12) - Mean($close, 26) - Mean(Mean($close, 12) - Mean($close, 26), 9)"},
    "atr": {"tr": _TR, "atr": f"Mean({_TR}, 14)"}, "obv": {"obv": "CumSum(If($close < Ref($close, 1), -$volume, $volume))"},
}
#: Pipeline factors over fixed windows; strict.
FACTORS = {
    "returns": "$close / Ref($close, 9) - 1", "percent_change": "($close - Ref($close, 9)) / Abs(Ref($close, 9))", "daily_returns": "$close / Ref($close, 1) - 1",
    "sma": "Mean($close, 10)", "weighted_average": "Sum($close * $volume, 10) / Sum($volume, 10)", "vwap": "Sum($close * $volume, 5) / Sum($volume, 5)",
    "dollar_volume": "Sum($close * $volume, 10) / 10", "ewma": "FixedEWMA($close, 10, 0.9)", "lwma": "LinearWMA($close, 10)",
    "annualized_volatility": "Std0($close / Ref($close, 1) - 1, 20) * 15.874507866387544", "rsi15": f"100 - 100 / (1 + Mean({_UP}, 14) / Mean({_DOWN}, 14))",
    "aroon_up": "100 * (IdxMax($high, 10) - 1) / 9", "aroon_down": "100 * (IdxMin($low, 10) - 1) / 9",
    "fast_stochastic": "100 * ($close - Min($low, 14)) / (Max($high, 14) - Min($low, 14))", "rocp": "($close - Ref($close, 9)) / Ref($close, 9) * 100",
    "tenkan": "(Max($high, 9) + Min($low, 9)) / 2", "kijun": "(Max($high, 26) + Min($low, 26)) / 2", "senkou_a": "((Max($high, 9) + Min($low, 9)) / 2 + (Max($high, 26) + Min($low, 26)) / 2) / 2",
    "senkou_b": "(Max($high, 52) + Min($low, 52)) / 2", "chikou": "Ref($close, 25)", "true_range": _TR,
    "macd_signal": "FixedEWMA(FixedEWMA($close, 12, 0.8461538461538461) - FixedEWMA($close, 26, 0.9259259259259259), 9, 0.8)",
}
#: One operator each, with the panel's columns it is shown on.
ELEMENTWISE = {
    "arithmetic": {"a": "$close + $open", "b": "$close - $open", "c": "$close * $volume", "d": "$close / ($high - $low)", "e": "$volume % 7", "f": "Power($close, 0.5)", "g": "-$close"},
    "comparisons": {"a": "$close > $open", "b": "$close >= $open", "c": "$close < Ref($close, 1)", "d": "$close <= $open", "e": "Eq($high, $low)", "f": "Ne($close, Ref($close, 1))"},
    "logic": {"a": "($close > $open) & ($volume > 100)", "b": "($close > $open) | ($volume > 100)", "c": "~($close > $open)", "d": "If($close > Ref($close, 1), $close, $open)", "e": "IsNull(Ref($close, 1))", "f": "NotNull(Ref($close, 1))"},
    "greater_less": {"a": "Greater($open, Ref($close, 1))", "b": "Less($open, Ref($close, 1))", "c": "Clip($close, 1000, 1500)", "d": "Fillna(Ref($close, 1), 0)", "e": "Where($close > $open, $close)"},
    "math": {"a": "Abs($open - $close)", "b": "Sign($open - $close)", "c": "Log($volume)", "d": "Log10($volume)", "e": "Log1p($volume)", "f": "Exp($close / 10000)", "g": "Expm1($close / 1000)", "h": "Sqrt($close)"},
    "trigonometry": {"a": "Sin($close)", "b": "Cos($close)", "c": "Tan($close / 10000)", "d": "Arcsin($low / $high)", "e": "Arccos($low / $high)", "f": "Arctan($close)", "g": "Sinh($close / 1000)", "h": "Cosh($close / 1000)", "i": "Tanh($close / 1000)", "j": "Arcsinh($close)", "k": "Arccosh($close)", "l": "Arctanh($low / $high / 2)"},
}
ROLLING = {
    **{n.lower(): {"v": f"{n}($close, 5)", "w": f"{n}($close, 0)"} for n in ("Mean", "Sum", "Std", "Var", "Max", "Min", "Med", "Count", "Delta", "Ref")},
    "skew": {"v": "Skew($close, 10)"}, "kurt": {"v": "Kurt($close, 10)"}, "idxmax": {"v": "IdxMax($close, 10)"}, "idxmin": {"v": "IdxMin($close, 10)"},
    "quantile": {"v": "Quantile($close, 10, 0.8)", "w": "Quantile($close, 10, 0.25)"}, "mad": {"v": "Mad($close, 10)"}, "rank": {"v": "Rank($close, 10)"},
    "slope": {"v": "Slope($close, 10)"}, "rsquare": {"v": "Rsquare($close, 10)"}, "resi": {"v": "Resi($close, 10)"}, "wma": {"v": "WMA($close, 10)"},
    "corr": {"v": "Corr($close, $volume, 10)"}, "cov": {"v": "Cov($close, $volume, 10)"}, "beta_rolling": {"v": "Beta($close, $open, 10)", "w": "Alpha($close, $open, 10)"},
    "fill": {"v": "FFill(Where($close > $open, $close))", "w": "BFill(Where($close > $open, $close))"}, "expanding": {"a": "CumSum($close)", "b": "Max($close, 0)", "c": "Min($close, 0)", "d": "Std0($close, 0)", "e": "CumProd($close / Ref($close, 1))"},
    "crossed": {"v": "CrossedAbove($close, Mean($close, 5))", "w": "CrossedAbove(Mean($close, 5), $close)"},
    "windows_of_filters": {"a": "All($close > $open, 3)", "b": "Any($close > $open, 3)", "c": "AtLeastN($close > $open, 5, 3)", "d": "AllPresent(Ref($close, 1), 3)"},
    "nested": {"v": "Std(Abs($close / Ref($close, 1) - 1) * $volume, 5)", "w": "Mean(Delta(Mean($close, 3), 1), 4)"},
}
FUTURE = {
    "future_mean": {"v": "NextMean($close, 5)"}, "future_std": {"v": "NextStd($close, 5)"}, "future_min": {"v": "NextMin($low, 5)"}, "future_max": {"v": "NextMax($high, 5)"},
    "fixed_labels": {"v": "Ref($close, -3) / $close - 1"}, "mean_labels": {"v": "NextMean($close, 5) / $close - 1"},
}
CROSS = {
    "demean": {"v": "Demean($close)"}, "zscore": {"v": "ZScore($close)", "w": "CsZScore($close)"}, "robust_zscore": {"v": "RobustZ($close)"},
    "ranks": {"a": "CsOrdinal($volume)", "b": "CsMinRank($volume)", "c": "CsMaxRank($volume)", "d": "CsDense($volume)", "e": "CsPctRank($volume)", "f": "CsRankNorm($volume)"},
    "winsorize": {"v": "Winsorize($close, 0.05, 0.95)"}, "quantiles": {"a": "Quantiles($close, 4)", "b": "Quantiles($close, 5)", "c": "Quantiles($close, 10)"},
    "top_bottom": {"a": "Top($close, 5)", "b": "Bottom($close, 5)"}, "percentile_between": {"v": "PercentileBetween($close, 20, 80)"},
    "day_summary": {"a": "CsMean($close)", "b": "CsStd($close)", "c": "CsMax($close)", "d": "CsMin($close)", "e": "CsMedian($close)", "f": "CsSum($close)", "g": "CsCount($close)"},
    "cs_fill": {"v": "CsFill(Ref($close, 3))"}, "market_beta": {"v": "Beta($close / Ref($close, 1) - 1, CsMean($close / Ref($close, 1) - 1), 12)", "w": "Corr($close, CsMean($close), 12)"},
    "spearman": {"v": "Spearman($close, $volume, 12)"},
}
