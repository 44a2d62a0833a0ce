"""Technical indicators that are recurrences.

Each indicator is a small state machine: a factory returns a step that takes
one bar (open, high, low, close, volume) and gives its outputs, None before it
is warm. Series are laid out by key and sorted, and every task streams its
series through the machines batch by batch, so memory holds one Arrow batch and
the state of one series, however long it is. A recurrence has to walk its
series in order; a hot series takes one task's time but not its memory.

Exponential means start at the first value (alpha 2 / (n + 1)); Wilder means
start as the plain mean of the first n values."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Value = float | None
Step = Callable[[float, float, float, float, float], tuple[Value, ...]]
KEYS = ["symbol", "exchange", "interval"]
REGISTRY: dict[str, tuple[Callable[..., Step], int]] = {}


def machine(outputs: int = 1) -> Callable[[Callable[..., Step]], Callable[..., Step]]:
    def put(f: Callable[..., Step]) -> Callable[..., Step]:
        REGISTRY[f.__name__] = (f, outputs)
        return f

    return put


# ---- parts
def ema_of(n: int, alpha: float | None = None) -> Callable[[Value], Value]:
    a = alpha if alpha is not None else 2.0 / (n + 1)
    e: list[Value] = [None]

    def step(x: Value) -> Value:
        if x is not None:
            e[0] = x if e[0] is None else e[0] + a * (x - e[0])
        return e[0]

    return step


def wilder_of(n: int) -> Callable[[Value], Value]:
    s = [0.0, 0]

    def step(x: Value) -> Value:
        if x is None:
            return s[0] if s[1] >= n else None
        s[1] += 1
        if s[1] < n:
            s[0] += x
            return None
        s[0] = (s[0] + x) / n if s[1] == n else (s[0] * (n - 1) + x) / n
        return s[0]

    return step


def window_of(n: int) -> Callable[[Value], deque | None]:
    d: deque = deque(maxlen=n)

    def step(x: Value) -> deque | None:
        if x is not None:
            d.append(x)
        return d if len(d) == n and x is not None else None

    return step


def mean_of(n: int) -> Callable[[Value], Value]:
    w = window_of(n)

    def step(x: Value) -> Value:
        d = w(x)
        return None if d is None else sum(d) / n

    return step


def delay_of(n: int) -> Callable[[Value], Value]:
    d: deque = deque([None] * n)

    def step(x: Value) -> Value:
        d.append(x)
        return d.popleft()

    return step


def range_of() -> Callable[[float, float, float], float]:
    """True range; the first bar's is high - low."""
    p: list[Value] = [None]

    def step(h: float, lo: float, c: float) -> float:
        t = h - lo if p[0] is None else max(h - lo, abs(h - p[0]), abs(lo - p[0]))
        p[0] = c
        return t

    return step


def minus(a: Value, b: Value) -> Value:
    return None if a is None or b is None else a - b


def ratio(a: Value, b: Value, k: float = 1.0) -> Value:
    return None if a is None or b is None or b == 0 else k * a / b


# ---- means
@machine()
def ema(period: int = 14) -> Step:
    e = ema_of(period)
    return lambda o, h, lo, c, v: (e(c),)


@machine()
def ewm(span: int = 20) -> Step:
    e = ema_of(span)
    return lambda o, h, lo, c, v: (e(c),)


@machine()
def dema(period: int = 14) -> Step:
    a, b = ema_of(period), ema_of(period)

    def step(o, h, lo, c, v):
        x = a(c)
        return (2 * x - b(x),)

    return step


@machine()
def tema(period: int = 14) -> Step:
    a, b, d = ema_of(period), ema_of(period), ema_of(period)

    def step(o, h, lo, c, v):
        x = a(c)
        y = b(x)
        return (3 * x - 3 * y + d(y),)

    return step


@machine()
def t3(period: int = 21, v_factor: float = 0.7) -> Step:
    es = [ema_of(period) for _ in range(6)]
    b = v_factor
    k1, k2, k3, k4 = -(b**3), 3 * b * b + 3 * b**3, -6 * b * b - 3 * b - 3 * b**3, 1 + 3 * b + b**3 + 3 * b * b

    def step(o, h, lo, c, v):
        x, xs = c, []
        for e in es:
            x = e(x)
            xs.append(x)
        return (k1 * xs[5] + k2 * xs[4] + k3 * xs[3] + k4 * xs[2],)

    return step


@machine()
def zlema(period: int = 14) -> Step:
    d, e = delay_of((period - 1) // 2), ema_of(period)

    def step(o, h, lo, c, v):
        p = d(c)
        return (e(None if p is None else 2 * c - p),)

    return step


@machine()
def kama(length: int = 14, fast_length: int = 2, slow_length: int = 30) -> Step:
    f, s = 2 / (fast_length + 1), 2 / (slow_length + 1)
    d: deque = deque(maxlen=length + 1)
    k: list[Value] = [None]

    def step(o, h, lo, c, v):
        d.append(c)
        if len(d) <= length:
            return (None,)
        path = sum(abs(d[i] - d[i - 1]) for i in range(1, len(d)))
        er = abs(d[-1] - d[0]) / path if path else 0.0
        a = (er * (f - s) + s) ** 2
        k[0] = c if k[0] is None else k[0] + a * (c - k[0])
        return (k[0],)

    return step


@machine()
def mcginley(period: int = 14) -> Step:
    """The step never passes the close, so a collapse of the price cannot overshoot."""
    m: list[Value] = [None]

    def step(o, h, lo, c, v):
        m[0] = c if m[0] is None else m[0] + (c - m[0]) / max(1.0, period * (c / m[0]) ** 4)
        return (m[0],)

    return step


@machine()
def vidya(period: int = 14, alpha: float = 0.2) -> Step:
    d: deque = deque(maxlen=period + 1)
    y: list[Value] = [None]

    def step(o, h, lo, c, v):
        d.append(c)
        if len(d) <= period:
            return (None,)
        up = sum(max(0.0, d[i] - d[i - 1]) for i in range(1, len(d)))
        dn = sum(max(0.0, d[i - 1] - d[i]) for i in range(1, len(d)))
        k = abs(up - dn) / (up + dn) if up + dn else 0.0
        y[0] = c if y[0] is None else y[0] + alpha * k * (c - y[0])
        return (y[0],)

    return step


@machine()
def frama(period: int = 26) -> Step:
    n = period - period % 2
    hs, ls = deque(maxlen=n), deque(maxlen=n)
    f: list[Value] = [None]

    def step(o, h, lo, c, v):
        hs.append(h)
        ls.append(lo)
        p = (h + lo) / 2
        if len(hs) < n:
            return (None,)
        H, L, m = list(hs), list(ls), n // 2
        n1, n2, n3 = (max(H[:m]) - min(L[:m])) / m, (max(H[m:]) - min(L[m:])) / m, (max(H) - min(L)) / n
        d = (math.log(n1 + n2) - math.log(n3)) / math.log(2) if n1 + n2 > 0 and n3 > 0 else 1.0
        a = min(1.0, max(0.01, math.exp(-4.6 * (d - 1))))
        f[0] = p if f[0] is None else f[0] + a * (p - f[0])
        return (f[0],)

    return step


@machine(3)
def alligator(jaw_period: int = 13, jaw_shift: int = 8, teeth_period: int = 8, teeth_shift: int = 5, lips_period: int = 5, lips_shift: int = 3) -> Step:
    lines = [(wilder_of(n), delay_of(k)) for n, k in ((jaw_period, jaw_shift), (teeth_period, teeth_shift), (lips_period, lips_shift))]
    return lambda o, h, lo, c, v: tuple(d(w(c)) for w, d in lines)


@machine(2)
def gator_oscillator(jaw_period: int = 13, teeth_period: int = 8, lips_period: int = 5) -> Step:
    a = alligator(jaw_period, 8, teeth_period, 5, lips_period, 3)

    def step(o, h, lo, c, v):
        j, t, li = a(o, h, lo, c, v)
        return (None if j is None or t is None else abs(j - t), None if t is None or li is None else -abs(t - li))

    return step


# ---- momentum
@machine(3)
def macd(fast_period: int = 12, slow_period: int = 26, signal_period: int = 9) -> Step:
    f, s, g = ema_of(fast_period), ema_of(slow_period), ema_of(signal_period)

    def step(o, h, lo, c, v):
        m = f(c) - s(c)
        x = g(m)
        return (m, x, m - x)

    return step


@machine(3)
def ppo(fast_period: int = 12, slow_period: int = 26, signal_period: int = 9) -> Step:
    f, s, g = ema_of(fast_period), ema_of(slow_period), ema_of(signal_period)

    def step(o, h, lo, c, v):
        y = s(c)
        m = 100 * (f(c) - y) / y
        x = g(m)
        return (m, x, m - x)

    return step


def rsi_of(n: int) -> Callable[[Value], Value]:
    u, d = wilder_of(n), wilder_of(n)
    p: list[Value] = [None]

    def step(x: Value) -> Value:
        if x is None:
            return None
        q, p[0] = p[0], x
        if q is None:
            return None
        a, b = u(max(0.0, x - q)), d(max(0.0, q - x))
        if a is None or b is None:
            return None
        return 100.0 if b == 0 else 100 - 100 / (1 + a / b)

    return step


@machine()
def rsi(period: int = 14) -> Step:
    r = rsi_of(period)
    return lambda o, h, lo, c, v: (r(c),)


@machine(2)
def stochrsi(rsi_period: int = 14, stoch_period: int = 14, k_period: int = 3, d_period: int = 3) -> Step:
    r, w, k, d = rsi_of(rsi_period), window_of(stoch_period), mean_of(k_period), mean_of(d_period)

    def step(o, h, lo, c, v):
        x = r(c)
        q = w(x)
        s = None if q is None else (0.0 if max(q) == min(q) else 100 * (x - min(q)) / (max(q) - min(q)))
        y = k(s)
        return (y, d(y))

    return step


@machine()
def crsi(lenrsi: int = 3, lenupdown: int = 2, lenroc: int = 100) -> Step:
    a, b = rsi_of(lenrsi), rsi_of(lenupdown)
    past: deque = deque(maxlen=lenroc)
    s = [None, 0.0]

    def step(o, h, lo, c, v):
        p, s[0] = s[0], c
        if p is None:
            a(c)
            b(0.0)
            return (None,)
        s[1] = (max(s[1], 0) + 1) if c > p else (min(s[1], 0) - 1) if c < p else 0.0
        roc = c / p - 1
        rank = 100 * sum(x < roc for x in past) / lenroc if len(past) == lenroc else None
        past.append(roc)
        x, y = a(c), b(s[1])
        return (None if rank is None or x is None or y is None else (x + y + rank) / 3,)

    return step


@machine()
def trix(length: int = 18) -> Step:
    es = [ema_of(length) for _ in range(3)]
    p: list[Value] = [None]

    def step(o, h, lo, c, v):
        x = c
        for e in es:
            x = e(x)
        q, p[0] = p[0], x
        return (None if q is None else 100 * (x / q - 1),)

    return step


@machine(2)
def tsi(long_period: int = 25, short_period: int = 13, signal_period: int = 13) -> Step:
    a, b, d, e, g = ema_of(long_period), ema_of(short_period), ema_of(long_period), ema_of(short_period), ema_of(signal_period)
    p: list[Value] = [None]

    def step(o, h, lo, c, v):
        q, p[0] = p[0], c
        if q is None:
            return (None, None)
        m = c - q
        t = ratio(b(a(m)), e(d(abs(m))), 100.0)
        return (t, g(t))

    return step


@machine()
def stc(fast_length: int = 23, slow_length: int = 50, cycle_length: int = 10, d1_length: int = 3, d2_length: int = 3) -> Step:
    f, s, w1, w2, e1, e2 = ema_of(fast_length), ema_of(slow_length), window_of(cycle_length), window_of(cycle_length), ema_of(d1_length), ema_of(d2_length)

    def pct(x: Value, q: deque | None) -> Value:
        return None if q is None else (0.0 if max(q) == min(q) else 100 * (x - min(q)) / (max(q) - min(q)))

    def step(o, h, lo, c, v):
        m = f(c) - s(c)
        d = pct(m, w1(m))
        y = None if d is None else e1(d)
        z = pct(y, w2(y))
        return (None if z is None else e2(z),)

    return step


@machine(2)
def fisher(length: int = 9) -> Step:
    w = window_of(length)
    s = [0.0, 0.0, None]

    def step(o, h, lo, c, v):
        x = (h + lo) / 2
        q = w(x)
        if q is None:
            return (None, None)
        hi, lw = max(q), min(q)
        raw = 0.0 if hi == lw else (x - lw) / (hi - lw) - 0.5
        s[0] = min(0.999, max(-0.999, 0.66 * raw + 0.67 * s[0]))
        before = s[2]
        s[1] = 0.5 * math.log((1 + s[0]) / (1 - s[0])) + 0.5 * s[1]
        s[2] = s[1]
        return (s[1], before)

    return step


# ---- range and direction
@machine()
def atr(period: int = 14) -> Step:
    t, w = range_of(), wilder_of(period)
    return lambda o, h, lo, c, v: (w(t(h, lo, c)),)


@machine()
def natr(period: int = 14) -> Step:
    a = atr(period)
    return lambda o, h, lo, c, v: (ratio(a(o, h, lo, c, v)[0], c, 100.0),)


def directional(n: int) -> Callable[[float, float, float], tuple[Value, Value, Value, Value]]:
    """Wilder's +DM, -DM, +DI, -DI."""
    t, a, b, r = range_of(), wilder_of(n), wilder_of(n), wilder_of(n)
    p: list = [None]

    def step(h: float, lo: float, c: float):
        q, p[0] = p[0], (h, lo)
        tr = t(h, lo, c)
        if q is None:
            return (None,) * 4
        up, dn = h - q[0], q[1] - lo
        x, y, z = a(up if up > dn and up > 0 else 0.0), b(dn if dn > up and dn > 0 else 0.0), r(tr)
        return (x, y, ratio(x, z, 100.0), ratio(y, z, 100.0))

    return step


@machine()
def plus_dm(period: int = 14) -> Step:
    d = directional(period)
    return lambda o, h, lo, c, v: (d(h, lo, c)[0],)


@machine()
def minus_dm(period: int = 14) -> Step:
    d = directional(period)
    return lambda o, h, lo, c, v: (d(h, lo, c)[1],)


@machine(2)
def dmi(period: int = 14) -> Step:
    d = directional(period)
    return lambda o, h, lo, c, v: d(h, lo, c)[2:]


def _dx(p: Value, m: Value) -> Value:
    return None if p is None or m is None else (0.0 if p + m == 0 else 100 * abs(p - m) / (p + m))


@machine()
def dx(period: int = 14) -> Step:
    d = directional(period)
    return lambda o, h, lo, c, v: (_dx(*d(h, lo, c)[2:]),)


@machine(3)
def adx(period: int = 14) -> Step:
    d, w = directional(period), wilder_of(period)

    def step(o, h, lo, c, v):
        p, m = d(h, lo, c)[2:]
        return (p, m, w(_dx(p, m)))

    return step


@machine()
def adxr(period: int = 14) -> Step:
    a, d = adx(period), delay_of(period)

    def step(o, h, lo, c, v):
        x = a(o, h, lo, c, v)[2]
        y = d(x)
        return (None if x is None or y is None else (x + y) / 2,)

    return step


@machine()
def chaikin(ema_period: int = 10, roc_period: int = 10) -> Step:
    e, d = ema_of(ema_period), delay_of(roc_period)

    def step(o, h, lo, c, v):
        x = e(h - lo)
        y = d(x)
        return (None if not y else 100 * (x / y - 1),)

    return step


@machine(2)
def chandelier_exit(period: int = 22, multiplier: float = 3.0) -> Step:
    a, hi, lw = atr(period), window_of(period), window_of(period)

    def step(o, h, lo, c, v):
        x, p, q = a(o, h, lo, c, v)[0], hi(h), lw(lo)
        return (None, None) if x is None or p is None else (max(p) - multiplier * x, min(q) + multiplier * x)

    return step


@machine(2)
def ckstop(p: int = 10, x: float = 1.0, q: int = 9) -> Step:
    a, hi, lw, hs, ls = atr(p), window_of(p), window_of(p), window_of(q), window_of(q)

    def step(o, h, lo, c, v):
        r, m, n = a(o, h, lo, c, v)[0], hi(h), lw(lo)
        s = hs(None if m is None or r is None else max(m) - x * r)
        t = ls(None if n is None or r is None else min(n) + x * r)
        return (None if s is None else max(s), None if t is None else min(t))

    return step


@machine(2)
def elderray(period: int = 13) -> Step:
    e = ema_of(period)

    def step(o, h, lo, c, v):
        x = e(c)
        return (h - x, lo - x)

    return step


@machine(3)
def keltner(ema_period: int = 20, atr_period: int = 10, multiplier: float = 2.0) -> Step:
    e, a = ema_of(ema_period), atr(atr_period)

    def step(o, h, lo, c, v):
        m, x = e(c), a(o, h, lo, c, v)[0]
        return (None, m, None) if x is None else (m + multiplier * x, m, m - multiplier * x)

    return step


@machine(3)
def starc(ma_period: int = 5, atr_period: int = 15, multiplier: float = 1.33) -> Step:
    e, a = mean_of(ma_period), atr(atr_period)

    def step(o, h, lo, c, v):
        m, x = e(c), a(o, h, lo, c, v)[0]
        return (None, m, None) if x is None or m is None else (m + multiplier * x, m, m - multiplier * x)

    return step


@machine()
def massindex(length: int = 10) -> Step:
    a, b, w = ema_of(9), ema_of(9), window_of(length)

    def step(o, h, lo, c, v):
        x = a(h - lo)
        q = w(ratio(x, b(x)))
        return (None if q is None else sum(q),)

    return step


@machine()
def psar(acceleration: float = 0.02, maximum: float = 0.2) -> Step:
    s: dict = {}

    def step(o, h, lo, c, v):
        if not s:
            s.update(h1=h, l1=lo, h2=h, l2=lo)
            return (None,)
        if "up" not in s:
            s["up"] = h + lo >= s["h1"] + s["l1"]
            s["sar"], s["ep"], s["af"] = (s["l1"], h, acceleration) if s["up"] else (s["h1"], lo, acceleration)
        else:
            x = s["sar"] + s["af"] * (s["ep"] - s["sar"])
            if s["up"]:
                x = min(x, s["l1"], s["l2"])
                if lo < x:
                    s.update(up=False, sar=s["ep"], ep=lo, af=acceleration)
                else:
                    s["sar"] = x
                    if h > s["ep"]:
                        s["ep"], s["af"] = h, min(maximum, s["af"] + acceleration)
            else:
                x = max(x, s["h1"], s["h2"])
                if h > x:
                    s.update(up=True, sar=s["ep"], ep=h, af=acceleration)
                else:
                    s["sar"] = x
                    if lo < s["ep"]:
                        s["ep"], s["af"] = lo, min(maximum, s["af"] + acceleration)
        s["h2"], s["l2"], s["h1"], s["l1"] = s["h1"], s["l1"], h, lo
        return (s["sar"],)

    return step


def _supertrend(width: Callable[[float, float, float, float, float], Value], k: float) -> Step:
    s: list = [None, None, None, 1]  # upper, lower, close before, direction

    def step(o, h, lo, c, v):
        a = width(o, h, lo, c, v)
        if a is None:
            s[2] = c
            return (None, None)
        up, dn = (h + lo) / 2 + k * a, (h + lo) / 2 - k * a
        if s[0] is not None:
            up = up if up < s[0] or s[2] > s[0] else s[0]
            dn = dn if dn > s[1] or s[2] < s[1] else s[1]
            s[3] = 1 if c > s[0] else -1 if c < s[1] else s[3]
        s[0], s[1], s[2] = up, dn, c
        return (dn if s[3] == 1 else up, float(s[3]))

    return step


@machine(2)
def supertrend(period: int = 10, multiplier: float = 3.0) -> Step:
    a = atr(period)
    return _supertrend(lambda o, h, lo, c, v: a(o, h, lo, c, v)[0], multiplier)


@machine(2)
def supertrend_ewm(period: int = 10, multiplier: float = 3.0) -> Step:
    """With the range smoothed exponentially by 1 / period."""
    t, e = range_of(), ema_of(period, 1.0 / period)
    return _supertrend(lambda o, h, lo, c, v: e(t(h, lo, c)), multiplier)


# ---- volume
@machine()
def force_index(length: int = 13) -> Step:
    e = ema_of(length)
    p: list[Value] = [None]

    def step(o, h, lo, c, v):
        q, p[0] = p[0], c
        return (e(None if q is None else (c - q) * v),)

    return step


@machine()
def cho(fast_period: int = 3, slow_period: int = 10) -> Step:
    a, b = ema_of(fast_period), ema_of(slow_period)
    s = [0.0]

    def step(o, h, lo, c, v):
        s[0] += 0.0 if h == lo else ((c - lo) - (h - c)) / (h - lo) * v
        return (a(s[0]) - b(s[0]),)

    return step


@machine(2)
def kvo(trig_len: int = 13, fast_x: int = 34, slow_x: int = 55) -> Step:
    a, b, g = ema_of(fast_x), ema_of(slow_x), ema_of(trig_len)
    p: list[Value] = [None]

    def step(o, h, lo, c, v):
        x = h + lo + c
        q, p[0] = p[0], x
        if q is None:
            return (None, None)
        f = v if x > q else -v
        k = a(f) - b(f)
        return (k, g(k))

    return step


def _index(up: bool, start: float, n: int) -> Step:
    e = ema_of(n)
    s: list = [start, None, None]

    def step(o, h, lo, c, v):
        if s[1] is not None and (v > s[2] if up else v < s[2]):
            s[0] *= c / s[1]
        s[1], s[2] = c, v
        return (s[0], e(s[0]))

    return step


@machine(2)
def nvi_with_ema(ema_length: int = 255) -> Step:
    return _index(False, 1000.0, ema_length)


@machine(2)
def pvi_with_signal(initial_value: float = 100.0, signal_length: int = 255) -> Step:
    return _index(True, initial_value, signal_length)


# ---- finite windows: the same value whatever came before the window
@machine()
def finite_ema(period: int = 10) -> Step:
    """Seeded anew in each window of 5 * period bars by the mean of its first ``period``."""
    w = window_of(5 * period)
    a = 2.0 / (period + 1)

    def step(o, h, lo, c, v):
        q = w(c)
        if q is None:
            return (None,)
        x = list(q)
        e = sum(x[:period]) / period
        for y in x[period:]:
            e += a * (y - e)
        return (e,)

    return step


@machine(2)
def finite_wilder(period: int = 14, window: int = 100) -> Step:
    """Wilder RSI and ATR within the last ``window`` bars."""
    d: deque = deque(maxlen=window)

    def step(o, h, lo, c, v):
        d.append((h, lo, c))
        if len(d) < window:
            return (None, None)
        r, a, x, y = rsi_of(period), atr(period), None, None
        for hh, ll, cc in d:
            x, y = r(cc), a(0, hh, ll, cc, 0)[0]
        return (x, y)

    return step


def apply(bars: DataFrame, names: str | list[str], **params: float) -> DataFrame:
    """Adds the outputs of one or more indicators to bars. One output is called
    by the indicator's name, several by name_0, name_1, ..."""
    names = [names] if isinstance(names, str) else names
    cols = [c if k == 1 else f"{c}_{i}" for c in names for k in [REGISTRY[c][1]] for i in range(k)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, steps = None, []
        for b in batches:
            out = []
            keys = zip(*[b[k].tolist() for k in KEYS])
            vals = zip(*[b[c].tolist() for c in ("open", "high", "low", "close", "volume")])
            for k, x in zip(keys, vals):
                if k != who:
                    who, steps = k, [REGISTRY[n][0](**params) for n in names]
                out.append(tuple(y for s in steps for y in s(*x)))
            yield pd.concat([b[[*KEYS, "timestamp"]], pd.DataFrame(out, columns=cols, index=b.index, dtype="float64")], axis=1)

    src = bars.select(*KEYS, "timestamp", "open", "high", "low", "close", "volume")
    kinds = ", ".join(f"{c} double" for c in cols)
    return src.repartition(*KEYS).sortWithinPartitions(*KEYS, "timestamp").mapInPandas(run, f"symbol string, exchange string, interval string, timestamp bigint, {kinds}")
