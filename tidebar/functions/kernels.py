"""Column kernels over the bars of one contract in time order. Missing is NULL throughout; NaN never enters."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

KEY, TIME = "contract", "datetime"


def per_contract():
    return Window.partitionBy(KEY).orderBy(TIME)


def so_far():
    return per_contract().rowsBetween(Window.unboundedPreceding, 0)


def trailing(n: int):
    return per_contract().rowsBetween(-(n - 1), 0)


def following(h: int):
    return per_contract().rowsBetween(1, h)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(per_contract())


def lead(x: str | Column, k: int = 1) -> Column:
    return F.lead(col(x), k).over(per_contract())


def diff(x: str | Column) -> Column:
    return col(x) - lag(x)


def filled(x: str | Column) -> Column:
    """The last value so far that is not missing."""
    return F.last(col(x), ignorenulls=True).over(so_far())


def div(a: str | Column, b: str | Column, fill: float | None = None) -> Column:
    """a / b, missing where b is 0; then every missing result becomes fill, if one is given."""
    out = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return out if fill is None else F.coalesce(out, F.lit(fill))


def rolling(f, x: str | Column, n: int) -> Column:
    """f over the last n rows, missing unless all n values are there."""
    return F.when(F.count(col(x)).over(trailing(n)) == n, f(col(x)).over(trailing(n)))


def ahead(f, x: str | Column, h: int) -> Column:
    """f over rows 1..h ahead, missing unless all h values are there."""
    return F.when(F.count(col(x)).over(following(h)) == h, f(col(x)).over(following(h)))


def zscore(x: str | Column, n: int) -> Column:
    """(x - mean) / population deviation of the last n rows; missing where the deviation is 0."""
    x = col(x).cast("double")
    return F.try_divide(x - rolling(F.avg, x, n), rolling(F.stddev_pop, x, n))


def running_sum(x: str | Column) -> Column:
    return F.sum(col(x)).over(so_far())


def flag(condition: Column) -> Column:
    """A condition in two-valued logic: missing is false."""
    return F.coalesce(condition, F.lit(False))


def ema_piece(span: int) -> int:
    """Rows that are summed at once for an exponential mean: (1 - a)^-rows stays within a double, (1 - a)^rows is far below its precision."""
    return 200 * (span + 1)


def ema_within(x: str | Column, span: int, row: str = "_row") -> Column:
    """The part of `ema` that comes from the rows of a contract's piece of `ema_piece` rows, as one cumulative window.

    Weight a = 2 / (span + 1), started at the first value. With q = 1 - a, the part of row k is q^k times the sum of c x q^-j over the piece's rows j up to k,
    where c is 1 for the contract's first row and a for others. `row` numbers the rows of a contract from 1. x must have no gaps.
    """
    a = 2.0 / (span + 1)
    q, j = F.lit(1 - a), ((col(row) - 1) % ema_piece(span)).cast("double")
    share = F.when(col(row) == 1, F.lit(1.0)).otherwise(F.lit(a))
    piece = F.floor((col(row) - 1) / ema_piece(span))
    so_far_in_piece = Window.partitionBy(KEY, piece).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(share * col(x) * F.pow(q, -j)).over(so_far_in_piece) * F.pow(q, j)


def ema(within: str, span: int, row: str = "_row", least: int | None = None) -> Column:
    """Recursive mean from row `span` (or `least`) on, out of the column `within` of `ema_within`: a piece adds what the last one ended with, of which older ones are no
    measurable part."""
    a = 2.0 / (span + 1)
    j = ((col(row) - 1) % ema_piece(span)).cast("double")
    before = F.last(F.when(col(row) % ema_piece(span) == 0, col(within)), ignorenulls=True).over(per_contract().rowsBetween(Window.unboundedPreceding, -1))
    return F.when(col(row) >= (span if least is None else least), col(within) + F.coalesce(before * F.pow(F.lit(1 - a), j + 1), F.lit(0.0)))


def fracdiff_weights(d: float = 0.4, threshold: float = 1e-4, cap: int = 200) -> list[float]:
    out = [1.0]
    while len(out) < cap:
        w = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(w) < threshold:
            break
        out.append(w)
    return out


def fracdiff(x: str | Column, d: float = 0.4) -> Column:
    """Fractional difference of order d over a fixed width, missing until the width is full."""
    weights = fracdiff_weights(d)
    n = len(weights)
    values = F.collect_list(col(x).cast("double")).over(trailing(n))
    # the oldest value comes first, so weights go backwards
    terms = F.zip_with(values, F.array(*[F.lit(w) for w in reversed(weights)]), lambda v, w: v * w)
    return F.when(F.count(col(x)).over(trailing(n)) == n, F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))


def average_rank(x: str | Column, *keys: str | Column) -> Column:
    """Rank within keys with ties at their middle; missing values have none."""
    x = col(x)
    known = [*map(col, keys), x.isNotNull()]
    w = Window.partitionBy(*known).orderBy(x)
    return F.when(x.isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*known, x)) - 1) / 2)


def bucket_of(x: Column, edges: Column) -> Column:
    """Number of the right-closed bucket among deduplicated edges: 1 for the lowest. Edges are rounded, so one within 1e-12 of x is not below it."""
    return F.size(F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: e + 1e-12 < x)) + 1


def distinct_edges(q: str | Column) -> Column:
    """The distinct values of an array of quantiles, to 12 places (interpolating between equal values may be off in the last bit)."""
    return F.array_distinct(F.transform(col(q), lambda e: F.round(e, 12)))


#: Numerators and denominators of Cody's rational fits of erf and erfc (1969), highest power last but for the first of each numerator, which is its highest.
_ERF = ((1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_FAR = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))


def _fraction(t: Column, fit: tuple) -> Column:
    """A quotient of polynomials in t by Horner's rule; the denominator's highest coefficient is 1."""
    above, below = F.lit(fit[0][0]), F.lit(1.0)
    for a, b in zip(fit[0][1:], fit[1], strict=True):
        above, below = above * t + a, below * t + b
    return above / below


def erfc(x: Column) -> Column:
    """The complementary error function in plain column arithmetic: relative error below 1e-14 up to 26, where it leaves a double."""
    y = F.abs(x)
    near = 1 - y * _fraction(y * y, _ERF)
    coarse = F.floor(y * 16) / 16  # exp(-y^2) in two factors, so that the square's rounding does not enter
    tail = F.exp(-coarse * coarse) * F.exp(-(y - coarse) * (y + coarse))
    inverse = F.try_divide(F.lit(1.0), y * y)
    far = (1 / math.sqrt(math.pi) - inverse * _fraction(inverse, _FAR)) / y
    upper = F.when(y <= 0.46875, near).when(y <= 4, tail * _fraction(y, _MIDDLE)).otherwise(F.when(y < 27, tail * far).otherwise(0.0))
    return F.when(x.isNotNull(), F.when(x < 0, 2 - upper).otherwise(upper))


def two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|)); missing where z is."""
    return erfc(F.abs(z) / math.sqrt(2))
