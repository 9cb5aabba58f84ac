"""RSI and MACD of a series from maps of its parts, which are combined by an associative product.

What a run of closes does to the averages is affine, so it can be told by a few
numbers before one knows which averages it starts from: for each average the factor
its old value keeps and what the run adds. Two runs in a row are one run, whose numbers
follow from theirs. The seed of RSI, the mean of the first changes, needs those changes
themselves; a map keeps its first ``period + 1`` closes for that, and no more.

A map is a struct:
``n, first, last``: closes in the run, its first and last;
``gain, loss``: sums of the run's own changes, faded to its end;
``head``: its first ``period + 1`` closes;
``keep_fast, keep_slow, keep_signal``: what old averages keep;
``from_fast, from_slow``: what old averages add to the signal;
``add_fast, add_slow, add_signal``: what the run adds.
A run without closes is NULL. Arguments are names of columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from backdate.functions.series import _MACD_FIELDS, _rest

_FIELDS = ("n", "first", "last", "gain", "loss", "head", "keep_fast", "keep_slow", "keep_signal",
           "from_fast", "from_slow", "add_fast", "add_slow", "add_signal")


def _faded(diffs: str, part: str, period: int) -> str:
    """The changes' sum, each faded by those after it; a missing change is no move."""
    keep, take = (period - 1) / period, 1 / period
    return f"aggregate({diffs}, 0D, (a, x) -> a * {keep!r}D + greatest({part}, 0D) * {take!r}D)"


def run_map(closes: str, diffs: str, period: int, fast: int, slow: int, signal: int) -> Column:
    """The map of an array of closes and its changes; NULL if there are none."""
    kf, ks, kg = (2.0 / (n + 1) for n in (fast, slow, signal))
    rf, rs, rg = 1.0 - kf, 1.0 - ks, 1.0 - kg
    state = "named_struct('kf', 1D, 'ks', 1D, 'kg', 1D, 'gf', 0D, 'gs', 0D, 'cf', 0D, 'cs', 0D, 'cg', 0D)"
    cf, cs = f"(a.cf * {rf!r}D + x * {kf!r}D)", f"(a.cs * {rs!r}D + x * {ks!r}D)"
    step = f"""named_struct(
        'kf', a.kf * {rf!r}D, 'ks', a.ks * {rs!r}D, 'kg', a.kg * {rg!r}D,
        'gf', a.gf * {rg!r}D + a.kf * {rf * kg!r}D, 'gs', a.gs * {rg!r}D - a.ks * {rs * kg!r}D,
        'cf', {cf}, 'cs', {cs}, 'cg', a.cg * {rg!r}D + ({cf} - {cs}) * {kg!r}D)"""
    values = ", ".join([
        f"'n', size({closes})", f"'first', {closes}[0]", f"'last', {closes}[size({closes}) - 1]",
        f"'gain', {_faded(diffs, 'x', period)}", f"'loss', {_faded(diffs, '-x', period)}",
        f"'head', slice({closes}, 1, {period + 1})",
        "'keep_fast', m.kf", "'keep_slow', m.ks", "'keep_signal', m.kg", "'from_fast', m.gf", "'from_slow', m.gs",
        "'add_fast', m.cf", "'add_slow', m.cs", "'add_signal', m.cg",
    ])
    return F.expr(f"CASE WHEN size({closes}) > 0 THEN aggregate({closes}, {state}, (a, x) -> {step}, m -> named_struct({values})) END")


def _product(p: str, q: str, period: int) -> str:
    """First the run ``p``, then the run ``q``."""
    keep, take = (period - 1) / period, 1 / period

    def moved(name: str, change: str) -> str:
        between = f"greatest({change}, 0D) * {take!r}D * pow({keep!r}D, {q}.n - 1)"
        return f"{p}.{name} * pow({keep!r}D, {q}.n) + {between} + {q}.{name}"

    values = {
        "n": f"{p}.n + {q}.n", "first": f"{p}.first", "last": f"{q}.last",
        "gain": moved("gain", f"{q}.first - {p}.last"), "loss": moved("loss", f"{p}.last - {q}.first"),
        "head": f"slice(concat({p}.head, {q}.head), 1, {period + 1})",
        **{f"keep_{s}": f"{p}.keep_{s} * {q}.keep_{s}" for s in ("fast", "slow", "signal")},
        **{f"from_{s}": f"{p}.keep_{s} * {q}.from_{s} + {p}.from_{s} * {q}.keep_signal" for s in ("fast", "slow")},
        **{f"add_{s}": f"{p}.add_{s} * {q}.keep_{s} + {q}.add_{s}" for s in ("fast", "slow")},
        "add_signal": f"{p}.add_fast * {q}.from_fast + {p}.add_slow * {q}.from_slow"
                      f" + {p}.add_signal * {q}.keep_signal + {q}.add_signal",
    }
    return "named_struct(" + ", ".join(f"'{f}', {values[f]}" for f in _FIELDS) + ")"


def product(maps: str, period: int) -> Column:
    """The map of all runs of an array in order; NULL if it is empty."""
    return F.expr(f"CASE WHEN size({maps}) > 0 THEN aggregate({_rest(maps, 2)}, {maps}[0], (p, q) -> {_product('p', 'q', period)}) END")


def rsi_of(run: str, period: int) -> Column:
    """Wilder's RSI with its averages seeded by the mean of the first ``period`` changes; needs that many."""
    keep, take = (period - 1) / period, 1 / period
    # The head's changes, faded as in the run's sums, are taken out and their mean put in.
    heads = f"transform(slice({run}.head, 2, {period}), (x, i) -> x - {run}.head[i])"

    def average(name: str, part: str) -> str:
        seed = f"""aggregate({heads}, named_struct('sum', 0D, 'faded', 0D), (a, x) -> named_struct(
            'sum', a.sum + greatest({part}, 0D), 'faded', a.faded * {keep!r}D + greatest({part}, 0D) * {take!r}D),
            a -> a.sum / {period} - a.faded)"""
        return f"{run}.{name} + pow({keep!r}D, {run}.n - {period + 1}) * {seed}"

    return F.expr(f"""element_at(transform(
        array(named_struct('gain', {average('gain', 'x')}, 'loss', {average('loss', '-x')})),
        a -> CASE WHEN a.loss = 0 THEN 100D WHEN a.gain = 0 THEN 0D ELSE 100D - 100D / (1D + a.gain / a.loss) END), 1)""")


def macd_of(run: str) -> Column:
    """Struct (macd, macd_signal, macd_histogram) after the run, whose averages start at its first close."""
    fast, slow = (f"({run}.first * {run}.keep_{s} + {run}.add_{s})" for s in ("fast", "slow"))
    signal = f"({run}.first * {run}.from_fast + {run}.first * {run}.from_slow + {run}.add_signal)"
    return F.expr(_MACD_FIELDS.format(fast=fast, slow=slow, signal=signal))
