"""Column expressions over American odds, margins and stakes. All but ``devig_n``, which works on Arrow batches, stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Newton steps to double precision. Both functions are convex and falling, so from the left of the root
#: each step stays on the left: powers start from exponent 1 (0 where the sum is under 1), Shin's share from 0.
POWER_STEPS, SHIN_STEPS = 12, 8


def implied_probability(price: Column) -> Column:
    """Probability that American odds imply; null for 0 and for null."""
    p = price.cast("double")
    return F.when(p > 0, F.lit(100.0) / (p + 100.0)).when(p < 0, -p / (100.0 - p))


def decimal_odds(price: Column) -> Column:
    p = price.cast("double")
    return F.when(p > 0, 1.0 + p / 100.0).when(p < 0, 1.0 - 100.0 / p)


def american_from_probability(prob: Column) -> Column:
    """Nearest American price, halves to even; null outside (0, 1)."""
    inside = (prob > 0) & (prob < 1)
    favourite = -F.bround(100.0 * prob / (1.0 - prob))
    return F.when(inside, F.when(prob >= 0.5, favourite).otherwise(F.bround(100.0 * (1.0 - prob) / prob))).cast("int")


def american_from_decimal(odds: Column) -> Column:
    return F.when(odds > 1, american_from_probability(1.0 / odds))


def overround(a: Column, b: Column) -> Column:
    return a + b - 1.0


def hold_pct(a: Column, b: Column) -> Column:
    """Share of the stakes that the book keeps, in percent."""
    return (1.0 - 1.0 / (a + b)) * 100.0


def edge_pct(prob: Column, price: Column) -> Column:
    """Expected profit of one unit, in percent."""
    return (prob * decimal_odds(price) - 1.0) * 100.0


def breakeven(price: Column) -> Column:
    return implied_probability(price)


# ---- removing the margin -------------------------------------------------------------------


def multiplicative(a: Column, b: Column) -> Column:
    return a / (a + b)


def additive(a: Column, b: Column) -> Column:
    """Half of the margin off each side; multiplicative where that leaves (0, 1)."""
    half = overround(a, b) / 2.0
    fine = (a - half > 0) & (b - half > 0)
    return F.when(fine, a - half).otherwise(multiplicative(a, b))


def power(a: Column, b: Column) -> Column:
    """a^k with k such that a^k + b^k = 1; null outside (0, 1)."""
    la, lb = F.log(a), F.log(b)

    def newton(k: Column, _: Column) -> Column:
        wa, wb = F.exp(k * la), F.exp(k * lb)
        return k - (wa + wb - 1.0) / (wa * la + wb * lb)

    k = F.aggregate(F.sequence(F.lit(1), F.lit(POWER_STEPS)), F.when(a + b > 1.0, 1.0).otherwise(0.0), newton)
    return F.when((a > 0) & (b > 0) & (a < 1) & (b < 1), F.exp(k * la))


def shin(a: Column, b: Column) -> Column:
    """For two outcomes Shin's method is the additive one; without a margin, the power method."""
    return F.when(a + b > 1.0, additive(a, b)).otherwise(power(a, b))


METHODS: dict[str, Callable[[Column, Column], Column]] = {"multiplicative": multiplicative, "additive": additive, "power": power, "shin": shin}


def devig(a: Column, b: Column, method: str = "power") -> Column:
    """Fair probability of the first of two outcomes."""
    return METHODS[method](a, b)


def method_used(a: Column, b: Column, method: str) -> Column:
    """The method that gave the value, where the one asked for does not apply."""
    half = overround(a, b) / 2.0
    if method == "additive":
        return F.when((a - half > 0) & (b - half > 0), "additive").otherwise("multiplicative")
    if method == "shin":
        return F.when(a + b > 1.0, "shin").otherwise("power")
    return F.lit(method)


def fair_prob_min(a: Column, b: Column) -> Column:
    """The least favourable of all methods."""
    return F.least(*[m(a, b) for m in METHODS.values()])


# ---- removing the margin of a market with any number of outcomes -----------------------------------


def _scaled(ps: np.ndarray) -> np.ndarray:
    """Each row of ``ps`` over its sum, which takes off what rounding left."""
    return ps / ps.sum(axis=1, keepdims=True)


def _excess(ps: np.ndarray) -> np.ndarray:
    return (ps.sum(axis=1, keepdims=True) - 1.0) / ps.shape[1]


def multiplicative_n(ps: np.ndarray) -> np.ndarray:
    return _scaled(ps)


def additive_applies(ps: np.ndarray) -> np.ndarray:
    """Whether an equal part of the margin leaves every outcome over 0."""
    return ps.min(axis=1) > _excess(ps)[:, 0]


def additive_n(ps: np.ndarray) -> np.ndarray:
    """An equal part of the margin off each outcome; multiplicative where one would fall to 0 or under."""
    return np.where(additive_applies(ps)[:, None], ps - _excess(ps), _scaled(ps))


def power_n(ps: np.ndarray) -> np.ndarray:
    """p^k with the k that makes the sum 1; a single outcome is certain."""
    if ps.shape[1] == 1:
        return np.ones_like(ps)
    logs = np.log(ps)
    k = np.where(ps.sum(axis=1, keepdims=True) > 1.0, 1.0, 0.0)
    for _ in range(POWER_STEPS):
        at = np.exp(k * logs)
        k = k - (at.sum(axis=1, keepdims=True) - 1.0) / (at * logs).sum(axis=1, keepdims=True)
    return _scaled(np.exp(k * logs))


#: Fixed value: the largest share of insiders that Shin's method considers.
MOST_INSIDERS = 0.99


def _shin_fair(z: np.ndarray | float, c: np.ndarray) -> np.ndarray:
    return (np.sqrt(z * z + 4.0 * (1.0 - z) * c) - z) / (2.0 * (1.0 - z))


def _shin_parts(ps: np.ndarray) -> np.ndarray:
    return ps * ps / ps.sum(axis=1, keepdims=True)


def shin_applies(ps: np.ndarray) -> np.ndarray:
    """Whether some share of insiders up to 0.99 explains the margin."""
    return (ps.sum(axis=1) > 1.0) & (_shin_fair(MOST_INSIDERS, _shin_parts(ps)).sum(axis=1) <= 1.0)


def shin_n(ps: np.ndarray) -> np.ndarray:
    """Shin's prices: a share z of the money knows the outcome. Where no z explains the margin, the power method."""
    fits = shin_applies(ps)
    out = np.empty_like(ps)
    out[~fits] = power_n(ps[~fits])
    c = _shin_parts(ps[fits])
    z = np.zeros((len(c), 1))
    for _ in range(SHIN_STEPS):
        root = np.sqrt(z * z + 4.0 * (1.0 - z) * c)
        slope = ((z - 2.0 * c) / root - 1.0) / (2.0 * (1.0 - z)) + (root - z) / (2.0 * (1.0 - z) * (1.0 - z))
        gap = ((root - z) / (2.0 * (1.0 - z))).sum(axis=1, keepdims=True) - 1.0
        z = np.clip(z - gap / slope.sum(axis=1, keepdims=True), 0.0, MOST_INSIDERS)
    out[fits] = _scaled(_shin_fair(z, c))
    return out


#: Fair prices of fields of one size, a row each; the method that stands in where one does not apply, and where it does.
METHODS_N: dict[str, Callable[[np.ndarray], np.ndarray]] = {"multiplicative": multiplicative_n, "additive": additive_n, "power": power_n, "shin": shin_n}
INSTEAD = {"additive": "multiplicative", "shin": "power"}
_APPLIES: dict[str, Callable[[np.ndarray], np.ndarray]] = {"additive": additive_applies, "shin": shin_applies}


def solve_fields(flat: np.ndarray, sizes: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probs, fine, own) of fields that stand one after another in ``flat``: the fair prices, whether all
    prices of a field are within (0, 1), and whether the method itself gave them.

    Fields of one size are solved together, as rows of a matrix.
    """
    ends = np.cumsum(sizes)
    probs, fine, own = np.zeros(len(flat)), np.zeros(len(sizes), bool), np.ones(len(sizes), bool)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        at = (ends[rows] - n)[:, None] + np.arange(n)
        valid = ((flat[at] > 0) & (flat[at] < 1)).all(axis=1)  # false for nulls, which are NaN here
        rows, at = rows[valid], at[valid]
        fine[rows], probs[at] = True, METHODS_N[method](flat[at])
        if method in INSTEAD:
            own[rows] = _APPLIES[method](flat[at])
    return probs, fine, own


def solve_fields(flat: np.ndarray, sizes: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probs, fine, own) of fields that stand one after another in ``flat``: the fair prices, whether all
    prices of a field are within (0, 1), and whether the method itself gave them.

    Fields of one size are solved together, as rows of a matrix.
    """
    ends = np.cumsum(sizes)
    probs, fine, own = np.zeros(len(flat)), np.zeros(len(sizes), bool), np.ones(len(sizes), bool)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        at = (ends[rows] - n)[:, None] + np.arange(n)
        valid = ((flat[at] > 0) & (flat[at] < 1)).all(axis=1)  # false for nulls, which are NaN here
        rows, at = rows[valid], at[valid]
        fine[rows], probs[at] = True, METHODS_N[method](flat[at])
        if method in INSTEAD:
            own[rows] = _APPLIES[method](flat[at])
    return probs, fine, own


def devig_n(ps: Column, method: str = "power") -> Column:
    """struct<probs, method_used> from the implied probabilities of all outcomes of a market.

    The name is that of the method that gave the values. Null for an empty array and where a
    probability is null or outside (0, 1).
    """

    def run(fields: pa.Array) -> pa.Array:
        sizes = np.nan_to_num(fields.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        probs, fine, own = solve_fields(fields.flatten().to_numpy(zero_copy_only=False).astype(float), sizes, method)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(probs))
        return pa.StructArray.from_arrays([lists, pa.array(np.where(own, method, INSTEAD.get(method, method)), pa.string())], ["probs", "method_used"], mask=pa.array(~fine))

    return F.arrow_udf(run, "probs array<double>, method_used string")(ps)


# ---- sides and lines -----------------------------------------------------------------------

# Kinds of markets by how their two sides pair.
SPREAD_LIKE = ("spreads", "spreads_h1", "spreads_h2", "spreads_q1", "spreads_q2", "spreads_q3", "spreads_q4", "alternate_spreads")
MONEYLINE_LIKE = ("h2h", "h2h_h1", "h2h_h2", "h2h_3_way")
FIRST_SIDES = ("home", "over", "yes")
SECOND_SIDES = ("away", "under", "no")


def pair_line(market: Column, side: Column, line: Column) -> Column:
    """The line under which both sides of a quote meet: home's for spreads, none for moneylines."""
    return F.when(market.isin(*MONEYLINE_LIKE), F.lit(0.0)).when(market.isin(*SPREAD_LIKE) & (side == "away"), F.lit(0.0) - line).otherwise(line)


def own_line(market: Column, side: Column, pair: Column) -> Column:
    """Back from the pair line to the side's own."""
    return F.when(market.isin(*SPREAD_LIKE) & (side == "away"), F.lit(0.0) - pair).otherwise(pair)


# ---- stakes ----------------------------------------------------------------------------------


def kelly(prob: Column, price: Column) -> Column:
    """Full Kelly fraction; 0 for a probability outside (0, 1) or odds without profit."""
    b = decimal_odds(price) - 1.0
    return F.when((prob > 0) & (prob < 1) & (b > 0), (prob * b - (1.0 - prob)) / b).otherwise(0.0)


def stake(prob: Column, price: Column, *, fraction: float = 0.25, cap_pct: float = 2.0) -> Column:
    """Fractional Kelly stake as a share of the bankroll; the fraction is 0.25 at most."""
    f = kelly(prob, price)
    return F.when(f > 0, F.least(f * min(fraction, 0.25), F.lit(cap_pct / 100.0))).otherwise(0.0)


def payout(result: Column, staked: Column, price: Column) -> Column:
    return F.when(result == "win", staked * (decimal_odds(price) - 1.0)).when(result == "loss", -staked).otherwise(0.0)


def shrink(observed: Column, n: Column, prior: Column, k: Column) -> Column:
    """n / (n + k) of the observed value, the rest of the prior; the observed one for k <= 0."""
    w = n / (n + k)
    return F.when(k <= 0, observed).otherwise(w * observed + (1.0 - w) * prior)


def blend(model: Column, market: Column, weight: Column) -> Column:
    """Weighted mean of two probabilities in log-odds; the market's where there is no model."""
    inside = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda p: F.log(inside(p) / (1.0 - inside(p)))
    z = weight * logit(model) + (1.0 - weight) * logit(market)
    return F.when(model.isNotNull() & (weight > 0), 1.0 / (1.0 + F.exp(-z))).otherwise(market)
