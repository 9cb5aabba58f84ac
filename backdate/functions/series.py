"""Indicators over one ordered array of closes, as array folds.

The arguments are names of columns. The caller guarantees the array is in date
order and bounded by its look-back (one visible bar per day). All arithmetic is
in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rest(array: str, start: int) -> str:
    """Elements from the 1-based position ``start`` on; empty if there are none."""
    return f"slice({array}, {start}, greatest(size({array}) - {start - 1}, 0))"


def changes(closes: str) -> Column:
    """Bar-to-bar differences; one shorter than the input."""
    return F.expr(f"transform({_rest(closes, 2)}, (x, i) -> x - {closes}[i])")


def pct_change(closes: str, bars: int) -> Column:
    """Percentage change of the last close over ``bars`` bars, 2 decimals."""
    return F.expr(
        f"round((try_divide(try_element_at({closes}, -1), try_element_at({closes}, {-1 - bars})) - 1) * 100, 2)"
    )


def rsi_mean_seed(diffs: str, period: int) -> Column:
    """Wilder's RSI whose averages start at the mean of the first ``period`` changes.

    A missing change counts as no move. Needs at least ``period`` changes.
    """
    keep, take = f"{(period - 1) / period!r}D", f"{1 / period!r}D"

    def seed(part: str) -> str:
        return f"aggregate(slice({diffs}, 1, {period}), 0D, (a, x) -> a + greatest({part}, 0D), a -> a / {period})"

    return F.expr(f"""
        aggregate(
          {_rest(diffs, period + 1)},
          named_struct('gain', {seed('x')}, 'loss', {seed('-x')}),
          (a, x) -> named_struct(
            'gain', a.gain * {keep} + greatest(x, 0D) * {take},
            'loss', a.loss * {keep} + greatest(-x, 0D) * {take}),
          a -> CASE WHEN a.loss = 0 THEN 100D WHEN a.gain = 0 THEN 0D
                    ELSE 100D - 100D / (1D + a.gain / a.loss) END)""")


_MACD_FIELDS = """named_struct(
            'macd', {fast} - {slow}, 'macd_signal', {signal}, 'macd_histogram', {fast} - {slow} - {signal})"""


def macd(closes: str, fast: int, slow: int, signal: int) -> Column:
    """Struct (macd, macd_signal, macd_histogram) after the last close.

    Averages start at the first close, so the first line value is 0. A missing
    close makes every later value NULL.
    """
    k_fast, k_slow, k_signal = (2.0 / (n + 1) for n in (fast, slow, signal))

    def ema(previous: str, x: str, k: float) -> str:
        return f"({x} * {k!r}D + {previous} * {1.0 - k!r}D)"

    f, s = ema("a.fast", "x", k_fast), ema("a.slow", "x", k_slow)
    first = f"{closes}[0]"
    return F.expr(f"""
        aggregate(
          {_rest(closes, 2)},
          named_struct('fast', {first}, 'slow', {first}, 'signal', {first} - {first}),
          (a, x) -> named_struct('fast', {f}, 'slow', {s}, 'signal', {ema('a.signal', f'({f} - {s})', k_signal)}),
          a -> {_MACD_FIELDS.format(fast='a.fast', slow='a.slow', signal='a.signal')})""")


# -- the variant that carries averages over gaps ---------------------------
# An average here is a struct (y, w): its value and the weight left to it. A gap
# lowers the weight; the next value is then blended by the weight that remains.

_NO_AVERAGE = "named_struct('y', CAST(NULL AS DOUBLE), 'w', 1D)"


def _blend(avg: str, x: str, alpha: float) -> str:
    kept = f"({avg}.w * {1.0 - alpha!r}D)"
    return f"""named_struct(
              'y', CASE WHEN {x} IS NULL THEN {avg}.y WHEN {avg}.y IS NULL THEN {x}
                        ELSE ({kept} * {avg}.y + {alpha!r}D * {x}) / ({kept} + {alpha!r}D) END,
              'w', CASE WHEN {x} IS NULL AND {avg}.y IS NOT NULL THEN {kept} ELSE 1D END)"""


def rsi_first_seed(diffs: str, period: int) -> Column:
    """RSI whose averages start at the first change; NaN when nothing ever moved."""
    alpha = 1.0 / period

    def part(x: str) -> str:
        return f"IF(x IS NULL, NULL, greatest({x}, 0D))"

    return F.expr(f"""
        aggregate(
          {diffs},
          named_struct('gain', {_NO_AVERAGE}, 'loss', {_NO_AVERAGE}, 'n', 0),
          (a, x) -> named_struct(
            'gain', {_blend('a.gain', part('x'), alpha)},
            'loss', {_blend('a.loss', part('-x'), alpha)},
            'n', a.n + IF(x IS NULL, 0, 1)),
          a -> CASE WHEN a.n < {period} THEN NULL
                    WHEN a.loss.y = 0 AND a.gain.y = 0 THEN CAST('NaN' AS DOUBLE)
                    WHEN a.loss.y = 0 THEN 100D
                    ELSE 100D - 100D / (1D + a.gain.y / a.loss.y) END)""")


def macd_over_gaps(closes: str, fast: int, slow: int, signal: int) -> Column:
    """Like :func:`macd`, but a missing close leaves the averages as they were."""
    a_fast, a_slow, a_signal = (2.0 / (n + 1) for n in (fast, slow, signal))
    start = f"named_struct('fast', {_NO_AVERAGE}, 'slow', {_NO_AVERAGE}, 'signal', {_NO_AVERAGE})"
    # Fast and slow move first; the signal then takes their new difference.
    moved = f"named_struct('fast', {_blend('a.fast', 'x', a_fast)}, 'slow', {_blend('a.slow', 'x', a_slow)}, 'signal', a.signal)"
    line = "(m.fast.y - m.slow.y)"
    signalled = f"""element_at(transform(array({moved}), m -> named_struct(
              'fast', m.fast, 'slow', m.slow, 'signal', {_blend('m.signal', line, a_signal)})), 1)"""
    fields = _MACD_FIELDS.format(fast="a.fast.y", slow="a.slow.y", signal="a.signal.y")
    return F.expr(f"aggregate({closes}, {start}, (a, x) -> {signalled}, a -> {fields})")
