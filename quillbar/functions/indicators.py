"""Technical indicators that window expressions can say: from the current row,
lagged rows, trailing frames, fixed kernels and running sums.

An indicator is a list of stages; each stage adds columns by window expressions
over (series, time), so that a later stage can frame what an earlier one made.
Frames are null until they are full. Every expression is built in; nothing
leaves the JVM.

Definitions are the public textbook ones; where those differ, the choice is
noted at the indicator."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

KEYS = ("symbol", "exchange", "interval")
ORDER = "timestamp"
P = f"partition by {', '.join(KEYS)} order by {ORDER}"


def over(n: int) -> str:
    return f"over ({P} rows between {n - 1} preceding and current row)"


UPTO = f"over ({P} rows between unbounded preceding and current row)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over ({P})" if n else x


def full(agg: str, x: str, n: int) -> str:
    """An aggregate of x over n rows, null until the frame holds n values."""
    return f"case when count({x}) {over(n)} = {n} then {agg}({x}) {over(n)} end"


def mean(x: str, n: int) -> str:
    return full("avg", x, n)


def total(x: str, n: int) -> str:
    return full("sum", x, n)


def top(x: str, n: int) -> str:
    return full("max", x, n)


def bottom(x: str, n: int) -> str:
    return full("min", x, n)


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def kernel(x: str, weights: list[float]) -> str:
    """Weighted mean of the newest rows, weights[0] on the current one."""
    s = sum(weights)
    return "(" + " + ".join(f"{w / s!r} * {lag(x, k)}" for k, w in enumerate(weights)) + ")"


def linear(n: int) -> list[float]:
    return [float(n - k) for k in range(n)]


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
TYP = "(high + low + close) / 3"


@dataclass(frozen=True)
class Indicator:
    stages: list[dict[str, str]]
    outputs: list[str]
    digits: int = 6


REGISTRY: dict[str, Callable[..., Indicator]] = {}


def indicator(f: Callable[..., Indicator]) -> Callable[..., Indicator]:
    REGISTRY[f.__name__] = f
    return f


def one(expr: str, *stages: dict[str, str], digits: int = 6) -> Indicator:
    return Indicator([*stages, {"value": expr}], ["value"], digits)


def many(outs: list[str], *stages: dict[str, str], digits: int = 6) -> Indicator:
    return Indicator([*stages, {f"out{i}": e for i, e in enumerate(outs)}], [f"out{i}" for i in range(len(outs))], digits)


@indicator
def accelerator_oscillator(period: int = 5) -> Indicator:
    return one(f"ao - ({mean('ao', period)})", {"hl2": "(high + low) / 2"}, {"ao": f"({mean('hl2', 5)}) - ({mean('hl2', 34)})"})


@indicator
def adl() -> Indicator:
    return one(f"sum(mfv) {UPTO}", {"mfv": "case when high = low then 0.0 else ((close - low) - (high - close)) / (high - low) * volume end"}, digits=0)


@indicator
def alma(period: int = 21, offset: float = 0.85, sigma: float = 6.0) -> Indicator:
    m, s = offset * (period - 1), period / sigma
    return one(kernel("close", [math.exp(-((period - 1 - k - m) ** 2) / (2 * s * s)) for k in range(period)]))


@indicator
def apo(fast_period: int = 12, slow_period: int = 26) -> Indicator:
    return one(f"({mean('close', fast_period)}) - ({mean('close', slow_period)})")


def _since(x: str, best: str, n: int) -> str:
    """Rows since the extreme of the last n + 1 rows, the newest on ties."""
    return f"rn - {best}(rn, struct({x}, {'rn' if best == 'max_by' else '-rn'})) {over(n + 1)}"


_RN = {"rn": f"row_number() over ({P})"}


@indicator
def aroon(period: int = 25) -> Indicator:
    up, down = (f"case when rn > {period} then 100.0 * ({period} - ({_since(x, b, period)})) / {period} end" for x, b in (("high", "max_by"), ("low", "min_by")))
    return many([up, down], _RN)


@indicator
def aroon_oscillator(period: int = 14) -> Indicator:
    up, down = (_since(x, b, period) for x, b in (("high", "max_by"), ("low", "min_by")))
    return one(f"case when rn > {period} then 100.0 * (({down}) - ({up})) / {period} end", _RN)


@indicator
def avgprice() -> Indicator:
    return one("(open + high + low + close) / 4")


@indicator
def awesome_oscillator(fast_period: int = 5, slow_period: int = 34) -> Indicator:
    return one(f"({mean('hl2', fast_period)}) - ({mean('hl2', slow_period)})", {"hl2": "(high + low) / 2"})


def _bands(period: int, k: float) -> dict[str, str]:
    return {"mid": mean("close", period), "sd": full("stddev_pop", "close", period)}


@indicator
def bbands(period: int = 20, std_dev: float = 2.0) -> Indicator:
    return many([f"mid + {std_dev} * sd", "mid", f"mid - {std_dev} * sd"], _bands(period, std_dev))


@indicator
def bbpercent(period: int = 20, std_dev: float = 2.0) -> Indicator:
    return one(f"case when sd > 1e-9 then (close - mid + {std_dev} * sd) / (2 * {std_dev} * sd) end", _bands(period, std_dev))


@indicator
def bbwidth(period: int = 20, std_dev: float = 2.0) -> Indicator:
    """Width as a ratio of the middle band."""
    return one(f"2 * {std_dev} * sd / mid", _bands(period, std_dev))


@indicator
def bop() -> Indicator:
    return one("case when high = low then 0.0 else (close - open) / (high - low) end")


def _lags(x: str, n: int) -> dict[str, str]:
    return {f"l{k}": lag(x, k) for k in range(n)}


@indicator
def cci(period: int = 20) -> Indicator:
    dev = " + ".join(f"abs(l{k} - m)" for k in range(period))
    return one(div("tp - m", f"case when ({dev}) > 1e-9 then 0.015 * ({dev}) / {period} end"), {"tp": TYP}, {"m": mean("tp", period), **_lags("tp", period)})


@indicator
def change(length: int = 1) -> Indicator:
    return one(f"close - {lag('close', length)}")


@indicator
def chop(period: int = 14) -> Indicator:
    return one(f"100 * log10({div(total('tr', period), f'({top("high", period)}) - ({bottom("low", period)})')}) / log10({period})", {"tr": TR})


@indicator
def cmf(period: int = 20) -> Indicator:
    v = {"mfv": "case when high = low then 0.0 else ((close - low) - (high - close)) / (high - low) * volume end", "vol": "cast(volume as double)"}
    return one(div(total("mfv", period), total("vol", period)), v)


@indicator
def cmo(period: int = 14) -> Indicator:
    """Plain sums of gains and losses."""
    u, d = total("u", period), total("d", period)
    return one(f"100 * {div(f'({u}) - ({d})', f'({u}) + ({d})')}", {"c": f"close - {lag('close')}"}, {"u": "case when c > 0 then c when c <= 0 then 0.0 end", "d": "case when c < 0 then -c when c >= 0 then 0.0 end"})


@indicator
def coppock(wma_length: int = 10, long_roc_length: int = 14, short_roc_length: int = 11) -> Indicator:
    r = f"100 * (close / {lag('close', long_roc_length)} - 1) + 100 * (close / {lag('close', short_roc_length)} - 1)"
    return one(kernel("r", linear(wma_length)), {"r": r})


@indicator
def donchian(period: int = 20) -> Indicator:
    return many(["u", "(u + d) / 2", "d"], {"u": top("high", period), "d": bottom("low", period)})


@indicator
def dpo(period: int = 21) -> Indicator:
    """Price against the mean of period / 2 + 1 rows ago."""
    return one(f"close - {lag('m', period // 2 + 1)}", {"m": mean("close", period)})


@indicator
def emv(length: int = 14, divisor: int = 10000) -> Indicator:
    move = f"((high + low) / 2 - ({lag('high')} + {lag('low')}) / 2) * (high - low) * {divisor} / nullif(volume, 0)"
    return one(mean("e", length), {"e": move})


@indicator
def rising(length: int = 1) -> Indicator:
    """1 when each of the last ``length`` moves was up."""
    return one(f"case when rn > {length} then sum(up) {over(length)} end = {length}", {"up": f"case when close > {lag('close')} then 1 else 0 end", **_RN})


@indicator
def falling(length: int = 1) -> Indicator:
    return one(f"case when rn > {length} then sum(dn) {over(length)} end = {length}", {"dn": f"case when close < {lag('close')} then 1 else 0 end", **_RN})


@indicator
def fractals(periods: int = 2) -> Indicator:
    """The row ``periods`` back is the extreme of the 2 * periods + 1 rows around it; known only now."""
    n = 2 * periods + 1
    return many([f"{lag('high', periods)} = ({top('high', n)})", f"{lag('low', periods)} = ({bottom('low', n)})"])


@indicator
def highest(period: int = 14) -> Indicator:
    return one(top("close", period))


@indicator
def lowest(period: int = 14) -> Indicator:
    return one(bottom("close", period))


@indicator
def hma(period: int = 14) -> Indicator:
    return one(kernel("d", linear(int(math.sqrt(period)))), {"d": f"2 * {kernel('close', linear(period // 2))} - {kernel('close', linear(period))}"})


@indicator
def hv(length: int = 10, annual: int = 365, per: int = 1) -> Indicator:
    return one(f"({full('stddev_samp', 'r', length)}) * sqrt({annual}.0 / {per}) * 100", {"r": f"ln(close / {lag('close')})"})


@indicator
def ichimoku(conversion_periods: int = 9, base_periods: int = 26, lagging_span2_periods: int = 52, displacement: int = 26) -> Indicator:
    """Conversion, base, the two spans as displaced to the current row, and the
    close that the lagging span puts ``displacement`` rows back."""
    mid = lambda n: f"(({top('high', n)}) + ({bottom('low', n)})) / 2"
    k = displacement - 1
    return many(["conv", "base", lag("(conv + base) / 2", k), lag("wide", k), f"lead(close, {k}) over ({P})"], {"conv": mid(conversion_periods), "base": mid(base_periods), "wide": mid(lagging_span2_periods)})


@indicator
def kst(signal: int = 9) -> Indicator:
    roc = {f"r{i}": f"100 * (close / {lag('close', n)} - 1)" for i, n in enumerate((10, 15, 20, 30), 1)}
    k = " + ".join(f"{i} * ({mean(f'r{i}', n)})" for i, n in enumerate((10, 10, 10, 15), 1))
    return many(["k", mean("k", signal)], roc, {"k": k})


def _regr(f: str, x: str, n: int) -> str:
    return f"case when count({x}) {over(n)} = {n} then {f}({x}, rn) {over(n)} end"


@indicator
def linreg(period: int = 14) -> Indicator:
    return one("a + b * rn", _RN, {"b": _regr("regr_slope", "close", period), "a": _regr("regr_intercept", "close", period)})


@indicator
def linregangle(period: int = 14) -> Indicator:
    return one("atan(b) * 180 / pi()", _RN, {"b": _regr("regr_slope", "close", period)})


@indicator
def linregintercept(period: int = 14) -> Indicator:
    """Fitted value at the first row of the frame."""
    return one(f"a + b * (rn - {period - 1})", _RN, {"b": _regr("regr_slope", "close", period), "a": _regr("regr_intercept", "close", period)})


@indicator
def lrslope(period: int = 100, interval: int = 1) -> Indicator:
    return one(f"({_regr('regr_slope', 'close', period)}) / {interval}", _RN)


@indicator
def tsf(period: int = 14) -> Indicator:
    return one("a + b * (rn + 1)", _RN, {"b": _regr("regr_slope", "close", period), "a": _regr("regr_intercept", "close", period)})


@indicator
def ma_envelopes(period: int = 20, percentage: float = 2.5) -> Indicator:
    return many([f"m * (1 + {percentage} / 100.0)", "m", f"m * (1 - {percentage} / 100.0)"], {"m": mean("close", period)}, digits=8)


@indicator
def median(period: int = 3) -> Indicator:
    return one(f"case when count(close) {over(period)} = {period} then percentile(close, 0.5) {over(period)} end")


@indicator
def medprice() -> Indicator:
    return one("(high + low) / 2")


@indicator
def mfi(period: int = 14) -> Indicator:
    f = {"up": f"case when tp > {lag('tp')} then tp * volume when tp <= {lag('tp')} then 0.0 end", "dn": f"case when tp < {lag('tp')} then tp * volume when tp >= {lag('tp')} then 0.0 end"}
    return one(f"100 * {div(total('up', period), f'({total("up", period)}) + ({total("dn", period)})')}", {"tp": TYP}, f)


@indicator
def midpoint(period: int = 14) -> Indicator:
    return one(f"(({top('close', period)}) + ({bottom('close', period)})) / 2")


@indicator
def midprice(period: int = 14) -> Indicator:
    return one(f"(({top('high', period)}) + ({bottom('low', period)})) / 2")


@indicator
def mode(period: int = 20, bins: int = 10) -> Indicator:
    """Centre of the fullest of equal bins over the frame, the lowest on ties."""
    at = {f"b{k}": f"case when hi > lo then least({bins - 1}, cast(floor((l{k} - lo) / (hi - lo) * {bins}) as int)) else 0 end" for k in range(period)}
    n = {f"n{b}": " + ".join(f"case when b{k} = {b} then 1 else 0 end" for k in range(period)) for b in range(bins)}
    best = "greatest(" + ", ".join(f"n{b}" for b in range(bins)) + ")"
    pick = "case " + " ".join(f"when n{b} = {best} then {b}" for b in range(bins)) + " end"
    return one(f"case when hi is not null then lo + (({pick}) + 0.5) * (hi - lo) / {bins} end", {"hi": top("close", period), "lo": bottom("close", period), **_lags("close", period)}, at, n)


@indicator
def mom(period: int = 10) -> Indicator:
    return one(f"close - {lag('close', period)}")


def _volume_index(op: str, start: float) -> Indicator:
    g = {"g": f"case when volume {op} {lag('volume')} then ln(close / {lag('close')}) else 0.0 end"}
    return one(f"{start} * exp(sum(g) {UPTO})", g)


@indicator
def nvi() -> Indicator:
    """Starts at 1000."""
    return _volume_index("<", 1000.0)


@indicator
def pvi(initial_value: float = 100.0) -> Indicator:
    return _volume_index(">", initial_value)


_OBV = {"sv": f"case when close > {lag('close')} then volume when close < {lag('close')} then -volume else 0 end"}


@indicator
def obv() -> Indicator:
    return one(f"cast(sum(sv) {UPTO} as double)", _OBV, digits=0)


@indicator
def obv_smoothed(ma_length: int = 20) -> Indicator:
    return one(mean("o", ma_length), _OBV, {"o": f"cast(sum(sv) {UPTO} as double)"}, digits=2)


@indicator
def pivot_points() -> Indicator:
    """Pivot, three resistances and three supports from the row before."""
    h, lo = lag("high"), lag("low")
    return many(["p", "2 * p - l1", "p + h1 - l1", "h1 + 2 * (p - l1)", "2 * p - h1", "p - h1 + l1", "l1 - 2 * (h1 - p)"], {"p": lag(TYP), "h1": h, "l1": lo})


@indicator
def po(fast_period: int = 10, slow_period: int = 20) -> Indicator:
    return one("100 * (f - s) / s", {"f": mean("close", fast_period), "s": mean("close", slow_period)})


@indicator
def pvt() -> Indicator:
    return one(f"sum(x) {UPTO}", {"x": f"coalesce(volume * (close / {lag('close')} - 1), 0.0)"}, digits=0)


@indicator
def roc(length: int = 14) -> Indicator:
    return one(f"100 * (close / {lag('close', length)} - 1)")


@indicator
def rocp(period: int = 10) -> Indicator:
    return one(f"close / {lag('close', period)} - 1")


@indicator
def rocr(period: int = 10) -> Indicator:
    return one(f"close / {lag('close', period)}")


@indicator
def rocr100(period: int = 10) -> Indicator:
    return one(f"100 * close / {lag('close', period)}")


@indicator
def rvi(period: int = 10) -> Indicator:
    """Relative vigour: symmetric means of close - open against high - low."""
    sw = lambda x: f"({x} + 2 * {lag(x)} + 2 * {lag(x, 2)} + {lag(x, 3)}) / 6"
    v = div(total("n", period), f"case when ({total('d', period)}) > 1e-9 then ({total('d', period)}) end")
    return many(["v", sw("v")], {"co": "close - open", "hl": "high - low"}, {"n": sw("co"), "d": sw("hl")}, {"v": v})


@indicator
def rvol(period: int = 20) -> Indicator:
    return one(div("volume", mean("volume", period)))


@indicator
def rwi(period: int = 14) -> Indicator:
    """Random walk up and down: the strongest over lookbacks of 2 to ``period``, scale by the mean true range."""
    ks = range(2, period + 1)
    up = "greatest(" + ", ".join(f"(high - {lag('low', k)}) / (nullif(a{k}, 0) * sqrt({k}))" for k in ks) + ")"
    dn = "greatest(" + ", ".join(f"({lag('high', k)} - low) / (nullif(a{k}, 0) * sqrt({k}))" for k in ks) + ")"
    return many([f"case when rn > {period} then {x} end" for x in (up, dn)], {"tr": f"coalesce({TR}, high - low)", **_RN}, {f"a{k}": f"case when {mean('tr', k)} > 1e-9 then {mean('tr', k)} end" for k in ks})


@indicator
def sma(period: int = 14) -> Indicator:
    return one(mean("close", period))


@indicator
def stdev(period: int = 14) -> Indicator:
    """Population deviation."""
    return one(full("stddev_pop", "close", period))


@indicator
def stochastic(k_period: int = 14, smooth_k: int = 3, d_period: int = 3) -> Indicator:
    lo, hi = bottom("low", k_period), top("high", k_period)
    return many(["k", mean("k", d_period)], {"f": f"100 * {div(f'close - ({lo})', f'({hi}) - ({lo})')}"}, {"k": mean("f", smooth_k)})


@indicator
def stochf(fastk_period: int = 5, fastd_period: int = 3) -> Indicator:
    lo, hi = bottom("low", fastk_period), top("high", fastk_period)
    return many(["f", mean("f", fastd_period)], {"f": f"100 * {div(f'close - ({lo})', f'({hi}) - ({lo})')}"})


@indicator
def trima(period: int = 20) -> Indicator:
    a, b = (period + 1) // 2, period // 2 + 1
    return one(mean("m", b), {"m": mean("close", a)})


@indicator
def true_range() -> Indicator:
    return one(f"coalesce({TR}, high - low)")


@indicator
def typprice() -> Indicator:
    return one(TYP)


@indicator
def ultimate_oscillator(period1: int = 7, period2: int = 14, period3: int = 28) -> Indicator:
    bp = {"bp": f"close - least(low, {lag('close')}) + 0 * {lag('close')}", "tr": f"greatest(high, {lag('close')}) - least(low, {lag('close')}) + 0 * {lag('close')}"}
    a = [div(total("bp", n), f"case when ({total('tr', n)}) > 1e-9 then ({total('tr', n)}) end") for n in (period1, period2, period3)]
    return one(f"100 * (4 * {a[0]} + 2 * {a[1]} + {a[2]}) / 7", bp)


@indicator
def uo_oscillator(period1: int = 7, period2: int = 14, period3: int = 28) -> Indicator:
    return ultimate_oscillator(period1, period2, period3)


@indicator
def variance(lookback: int = 20) -> Indicator:
    """Sample variance of the simple returns."""
    return one(full("var_samp", "r", lookback), {"r": f"close / {lag('close')} - 1"}, digits=10)


@indicator
def volosc(short_length: int = 5, long_length: int = 10) -> Indicator:
    return one(f"100 * {div(f'({mean("volume", short_length)}) - ({mean("volume", long_length)})', mean('volume', long_length))}")


@indicator
def vroc(period: int = 25) -> Indicator:
    return one(f"100 * ({div('volume', lag('volume', period))} - 1)")


@indicator
def vwap() -> Indicator:
    """Anchored to the market day."""
    w = f"over (partition by {', '.join(KEYS)}, md order by {ORDER} rows between unbounded preceding and current row)"
    return one(div(f"sum(pv) {w}", f"cast(sum(volume) {w} as double)"), {"md": "cast(floor((timestamp + 19800) / 86400.0) as bigint)", "pv": f"({TYP}) * volume"})


@indicator
def vwma(period: int = 14) -> Indicator:
    return one(div(total("cv", period), total("volume", period)), {"cv": "close * volume"})


@indicator
def wclprice() -> Indicator:
    return one("(high + low + 2 * close) / 4")


@indicator
def williams_r(period: int = 14) -> Indicator:
    hi, lo = top("high", period), bottom("low", period)
    return one(f"-100 * {div(f'({hi}) - close', f'({hi}) - ({lo})')}")


@indicator
def wma(period: int = 14) -> Indicator:
    return one(kernel("close", linear(period)))


# ---- of two series or of conditions
def _cross(fast: int, slow: int) -> tuple[str, str, dict[str, str]]:
    """Conditions up and down; means that differ by float noise only are equal."""
    m = {"f": mean("close", fast), "s": mean("close", slow)}
    return f"{lag('f')} < {lag('s')} - 1e-9 and f > s + 1e-9", f"{lag('f')} > {lag('s')} + 1e-9 and f < s - 1e-9", m


@indicator
def crossover(fast: int = 5, slow: int = 20) -> Indicator:
    """Fast mean goes from below to above the slow one, strictly on both sides."""
    up, _, m = _cross(fast, slow)
    return one(up, m)


@indicator
def crossunder(fast: int = 5, slow: int = 20) -> Indicator:
    _, down, m = _cross(fast, slow)
    return one(down, m)


@indicator
def cross(fast: int = 5, slow: int = 20) -> Indicator:
    up, down, m = _cross(fast, slow)
    return one(f"({up}) or ({down})", m)


_MARK = {"p": f"close > {lag('close')} and {lag('close')} > {lag('close', 2)}", "q": f"close < {lag('close')} and {lag('close')} < {lag('close', 2)}"}


@indicator
def exrem() -> Indicator:
    """Keeps a primary signal only if no other primary stood since the last secondary."""
    m = {"m": "case when p then 1 when q then 2 end"}
    before = {"pm": f"last_value(m) ignore nulls over ({P} rows between unbounded preceding and 1 preceding)"}
    return one("coalesce(p, false) and coalesce(pm, 2) <> 1", _MARK, m, before)


@indicator
def flip() -> Indicator:
    """Latched by the primary, released by the secondary."""
    return one(f"coalesce(last_value(m) ignore nulls {UPTO}, 0) = 1", _MARK, {"m": "case when p then 1 when q then 0 end"})


@indicator
def valuewhen(n: int = 2) -> Indicator:
    """Close at the n-th latest bar on which the condition held, this one included."""
    stages = [{"v0": "case when p then close end"}]
    for k in range(1, n):
        stages.append({f"w{k}": f"last_value(v{k - 1}) ignore nulls over ({P} rows between unbounded preceding and 1 preceding)"})
        stages.append({f"v{k}": f"case when p then w{k} end"})
    return one(f"last_value(v{n - 1}) ignore nulls {UPTO}", _MARK, *stages)


@indicator
def correlation(period: int = 20) -> Indicator:
    """Rolling correlation of close and volume."""
    sd = {"sx": full("stddev_pop", "close", period), "sy": full("stddev_pop", "volume", period), "c": f"covar_pop(close, cast(volume as double)) {over(period)}"}
    return one("case when sx > 1e-6 and sy > 1e-6 then c / (sx * sy) end", sd, digits=5)


@indicator
def beta(period: int = 60) -> Indicator:
    """Rolling beta of the close's returns on the typical price's."""
    r = {"a": f"close / {lag('close')} - 1", "tp": TYP}
    m = {"b": f"tp / {lag('tp')} - 1"}
    return one(f"case when count(b) {over(period)} = {period} then (covar_samp(a, b) {over(period)}) / nullif(case when var_samp(b) {over(period)} > 1e-12 then var_samp(b) {over(period)} end, 0) end", r, m, digits=5)


@indicator
def median_bands(period: int = 9, width: float = 2.0) -> Indicator:
    """Median with bands of the mean true range."""
    m = f"case when count(close) {over(period)} = {period} then percentile(close, 0.5) {over(period)} end"
    return many([f"m + {width} * a", "m", f"m - {width} * a"], {"tr": f"coalesce({TR}, high - low)"}, {"m": m, "a": mean("tr", period)})


@indicator
def ulcerindex(period: int = 14) -> Indicator:
    return one(f"sqrt({mean('d2', period)})", {"pk": top("close", period)}, {"d2": "power(100 * (close / pk - 1), 2)"})


@indicator
def vi(period: int = 14) -> Indicator:
    """Vortex."""
    m = {"tr": TR, "vp": f"abs(high - {lag('low')})", "vm": f"abs(low - {lag('high')})"}
    return many([div(total(x, period), f"case when ({total('tr', period)}) > 1e-9 then ({total('tr', period)}) end") for x in ("vp", "vm")], m, digits=8)


def apply(bars: DataFrame, name: str, **params: float) -> DataFrame:
    """Adds an indicator's outputs to bars (symbol, exchange, interval, timestamp,
    open, high, low, close, volume)."""
    ind = REGISTRY[name](**params)
    out = bars
    for stage in ind.stages:
        out = out.selectExpr("*", *[f"{e} as `{c}`" for c, e in stage.items()])
    return out.select(*bars.columns, *ind.outputs)


def latest(bars: DataFrame, name: str, **params: float) -> DataFrame:
    """The newest bar of each series with its outputs."""
    from pyspark.sql import functions as F

    out = apply(bars, name, **params)
    rest = [c for c in out.columns if c not in KEYS]
    return out.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), ORDER).alias("v")).select(*KEYS, *[F.col(f"v.{c}").alias(c) for c in rest])


def twin(name: str, source: str = "bars", **params: float) -> tuple[str, Indicator]:
    """The same stages as nested selects for an ANSI SQL engine."""
    ind = REGISTRY[name](**params)
    sql = source
    for stage in ind.stages:
        cols = ", ".join(f'{e} as "{c}"' for c, e in stage.items())
        sql = f"(select *, {cols} from {sql})"
    sql = sql.replace("struct(", "row(").replace("percentile(", "quantile_cont(")
    sql = sql.replace(") ignore nulls over", " ignore nulls) over")
    return f"select {', '.join(KEYS)}, {ORDER}, {{}} from {sql}", ind
