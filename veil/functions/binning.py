"""Equal-width binning with midpoint labels, following ``pandas.cut(x, bins=n)``.

Edges come from the column's min and max (``n + 1`` numbers, computed on the driver); each row is
replaced by the midpoint of its bin's *label* interval, whose edges are rounded to 3 significant
fraction digits (more if needed to keep them distinct). Rows are assigned to bins by the unrounded
edges, right-closed. Everything per row is a native expression, the same for any number of bins: an
arithmetic bin index from the unshifted start and width, corrected by one step against the edges
(the division is off by at most one bin), then a look-up in the array of midpoints.

The edge and label recipe reproduces the numbers of pandas.cut and numpy.linspace (BSD 3-Clause).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of pandas.cut, which the midpoints must reproduce exactly: the range is widened by
# 0.1% (0.001) of itself (or of |x|, or by 0.001 when the range is 0); labels are rounded to 3
# significant fraction digits, raised one at a time below 20 until they are distinct.
RANGE_ADJUST = 0.001
LABEL_PRECISION = 3
MAX_LABEL_PRECISION = 20


def _power_of_ten(n: int) -> float:
    # numpy's power_of_ten(): exact table to 1e8, then repeated multiplication
    if n < 9:
        return float(10 ** n)
    ret = 1e9
    while n > 9:
        ret *= 10.0
        n -= 1
    return ret


def _rint(y: float) -> float:
    return float(round(y)) if math.isfinite(y) else y


def np_around(x: float, decimals: int) -> float:
    """``numpy.around`` for a float: scale, round half to even, unscale."""
    if decimals >= 0:
        f = _power_of_ten(decimals)
        return _rint(x * f) / f
    f = _power_of_ten(-decimals)
    return _rint(x / f) * f


def round_frac(x: float, precision: int) -> float:
    if not math.isfinite(x) or x == 0:
        return x
    frac, whole = math.modf(x)
    if whole == 0:
        digits = -int(math.floor(math.log10(abs(frac)))) - 1 + precision
    else:
        digits = precision
    return np_around(x, digits)


def linspace(start: float, stop: float, num: int) -> list[float]:
    div = num - 1
    delta = stop - start
    step = delta / div
    if step == 0:
        ys = [(i / div) * delta + start for i in range(num)]
    else:
        ys = [i * step + start for i in range(num)]
    ys[-1] = stop
    return ys


def cut_edges(mn: float, mx: float, bins: int) -> list[float]:
    if mn == mx:
        lo = mn - (RANGE_ADJUST * abs(mn) if mn != 0 else RANGE_ADJUST)
        hi = mx + (RANGE_ADJUST * abs(mx) if mx != 0 else RANGE_ADJUST)
        return linspace(lo, hi, bins + 1)
    edges = linspace(mn, mx, bins + 1)
    edges[0] -= (mx - mn) * RANGE_ADJUST
    return edges


def infer_precision(edges: list[float], base: int = LABEL_PRECISION) -> int:
    for p in range(base, MAX_LABEL_PRECISION):
        if len({round_frac(b, p) for b in edges}) == len(edges):
            return p
    return base


@dataclass(frozen=True)
class Bins:
    """Fitted bins: raw edges decide membership, label midpoints are the output values."""

    edges: tuple[float, ...]
    mids: tuple[float, ...]
    include_lowest: bool
    precision: int
    start: float  # edge i is i * step + start, but for the lowered first and the exact last one
    step: float

    @property
    def n(self) -> int:
        return len(self.mids)


def fit(mn: float, mx: float, bins: int, include_lowest: bool = True) -> Bins:
    if isinstance(bins, bool) or not isinstance(bins, int) or bins < 1:
        raise ValueError("`bins` should be a positive integer.")
    if math.isinf(mn) or math.isinf(mx):
        raise ValueError("cannot specify integer `bins` when input data contains infinity")
    edges = cut_edges(float(mn), float(mx), bins)
    if len(set(edges)) < len(edges):
        raise ValueError("Bin edges must be unique; the column's range is too small for this many bins.")
    p = infer_precision(edges)
    breaks = [round_frac(b, p) for b in edges]
    if include_lowest:
        breaks[0] = breaks[0] - 10 ** (-p)
    # labels may repeat when no precision below 20 separates them; pandas then lets those bins
    # share a label, and each bin keeps the midpoint of its own (possibly equal) label edges
    if not all(math.isfinite(x) for x in breaks):
        raise ValueError("Bin labels cannot be formed for this range (rounding overflows).")
    mids = tuple(0.5 * (breaks[i - 1] + breaks[i]) for i in range(1, len(breaks)))
    start = edges[0] if mn == mx else float(mn)
    return Bins(tuple(edges), mids, include_lowest, p, start, (edges[-1] - start) / bins)


def midpoint(v: Column, b: Bins, clamp: bool = False) -> Column:
    """Midpoint of ``v``'s bin as a double; null for null or (unless ``clamp``) out-of-range values."""
    n, first, last = b.n, b.edges[0], b.edges[-1]
    below = (v < first) | ((v == first) & F.lit(not b.include_lowest))
    above = v > last

    def edge(i: Column) -> Column:
        return F.when(i <= 0, F.lit(first)).when(i >= n, F.lit(last)).otherwise(i.cast("double") * b.step + b.start)

    # one literal, folded once by the optimizer, however many bins there are
    mids = F.split(F.lit(",".join(map(repr, b.mids))), ",").cast("array<double>")
    guess = F.least(F.greatest(F.ceil((v - b.start) / b.step), F.lit(1)), F.lit(n)).cast("int")
    # bin g covers (edge(g-1), edge(g)]
    g = F.when(v > edge(guess), guess + 1).when(v <= edge(guess - 1), guess - 1).otherwise(guess)
    inside = F.element_at(mids, F.least(F.greatest(g, F.lit(1)), F.lit(n)))
    out = F.when(v.isNull(), F.lit(None).cast("double"))
    if clamp:
        return out.when(below, F.lit(b.mids[0])).when(above, F.lit(b.mids[-1])).otherwise(inside)
    return out.when(below | above, F.lit(None).cast("double")).otherwise(inside)
