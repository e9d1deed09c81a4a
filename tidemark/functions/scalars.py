"""Scalar rules as columns: missing values, validity, sizing, costs, hashes and the normal distribution."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
#: A dispersion is flat at or under this share of the level.
FLAT = 1e-12


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(INF)), x)


def is_flat(deviation: Column, mean_abs: Column) -> Column:
    """Whether a standard deviation is no dispersion at the level of the values."""
    return deviation.isNull() | (deviation <= FLAT * F.greatest(F.lit(1.0), mean_abs))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ohlc_fault(o: Column, h: Column, l: Column, c: Column, v: Column) -> Column:  # noqa: E741
    """The first fault of a bar, null for a valid one."""
    malformed = finite(o).isNull() | finite(h).isNull() | finite(l).isNull() | finite(c).isNull() | finite(v).isNull()
    return (
        F.when(malformed, "malformed")
        .when((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0), "non_positive")
        .when(h < l, "inverted_range")
        .when((o > h) | (o < l) | (c > h) | (c < l), "outside_range")
        .when(v < 0, "negative_volume")
    )


def to_float(x: Column) -> Column:
    """The number that a text states, null where it states none."""
    return x.try_cast("double")


def round_tick(price: Column) -> Column:
    """Four decimals under 1, else two."""
    return F.when(F.abs(price) < 1, F.round(price, 4)).otherwise(F.round(price, 2))


def whole_shares(quantity: Column) -> Column:
    return F.floor(quantity)


def under_minimum(quantity: Column, price: Column, least: float) -> Column:
    return F.abs(quantity) * price < least


def risk_size(capital: Column, price: Column, stop: Column, risk: float, most_risk: float, most_size: float) -> Column:
    """Shares by the risk budget, the position cap and the hard risk limit, whichever is least; 0 without a price or stop."""
    per_share = price * stop
    return F.when((price > 0) & (stop > 0), F.least(capital * risk / per_share, F.lit(most_size) / price, capital * most_risk / per_share)).otherwise(0.0)


def beta_scaled(size: Column, beta: Column) -> Column:
    """size over |beta|, which is held between 0.25 and 4."""
    return size / F.least(F.greatest(F.abs(beta), F.lit(0.25)), F.lit(4.0))


def weight_size(weight: Column, equity: Column, price: Column) -> Column:
    return F.when(price > 0, weight * equity / price).otherwise(0.0)


def trade_cost(notional: Column, adv: Column, vol: Column, *, commission_bps: float = 1.0, half_spread_bps: float = 2.0, eta: float = 0.1, linear: bool = False, cap: float | None = None) -> Column:
    """Commission, half spread and market impact of a trade.

    Impact is eta * vol * sqrt(participation), or linear in it; without a positive ADV there is
    none. participation above cap counts as cap.
    """
    size = F.abs(notional)
    part = F.when(adv > 0, size / adv)
    part = part if cap is None else F.least(part, F.lit(cap))
    impact = F.coalesce(eta * vol * (part if linear else F.sqrt(part)), F.lit(0.0)) * size
    return size * (commission_bps + half_spread_bps) / 1e4 + impact


def _positive(x: Column) -> Column:
    """Whether x is a number over 0; missing values are not."""
    x = x.cast("double")
    return F.coalesce((x > 0) & ~F.isnan(x), F.lit(False))


def cost_parts(shares: Column, price: Column, adv: Column, vol: Column, spread: Column | None = None, *, commission_bps: float = 1.0, spread_bps: float = 5.0, eta: float = 0.3, linear: bool = False, limit: float = 0.1) -> Column:
    """struct of notional, commission, spread_cost, impact_cost, total, participation and capped of a trade.

    spread, a fraction, is that of the model where it is null. Participation is shares over adv,
    infinite without a positive adv, and then there is no impact; capped tells that it exceeds
    limit and changes no cost. A trade of no notional costs nothing and takes no part.
    """
    size, traded = F.abs(shares) * price, _positive(F.abs(shares) * price)
    own = F.lit(spread_bps / 1e4) if spread is None else F.coalesce(spread, F.lit(spread_bps / 1e4))
    part = F.when(_positive(adv), F.abs(shares) / adv).otherwise(INF)
    impact = F.when(part < INF, eta * vol * (part if linear else F.sqrt(part)) * size).otherwise(0.0)
    of_trade = lambda x: F.when(traded, x).otherwise(0.0)
    parts = {"notional": size, "commission": commission_bps / 1e4 * size, "spread_cost": own / 2 * size, "impact_cost": impact, "total": commission_bps / 1e4 * size + own / 2 * size + impact, "participation": part}
    return F.struct(*[of_trade(x).alias(k) for k, x in parts.items()], (traded & (part > limit)).alias("capped"))


def cost_rate(parts: Column) -> Column:
    """One way, as a share of the notional; 0 for no trade."""
    return F.when(parts["notional"] > 0, parts["total"] / parts["notional"]).otherwise(0.0)


def annual_cost_rate(rate: Column, years: Column) -> Column:
    """A round trip's rate, spread over the years that it is held; infinite if it is not held."""
    return F.when(_positive(years), 2 * rate / years).otherwise(INF)


def carry_cost(notional: Column, is_short: Column, years: Column, *, borrow_bps: float = 50.0, own_rate: Column | None = None) -> Column:
    """What borrowing a short costs over the years that it is held, at its own yearly rate or the flat one."""
    rate = F.lit(borrow_bps / 1e4) if own_rate is None else F.coalesce(own_rate, F.lit(borrow_bps / 1e4))
    return F.when(is_short & _positive(years), rate * F.abs(notional) * years).otherwise(0.0)


def turnover_rate(spread: Column | None = None, *, commission_bps: float = 1.0, spread_bps: float = 5.0) -> Column:
    """The part of the cost that is linear in what is traded: commission and half spread."""
    own = F.lit(spread_bps / 1e4) if spread is None else F.coalesce(spread, F.lit(spread_bps / 1e4))
    return commission_bps / 1e4 + own / 2


def impact_coefficient(vol: Column, adv_dollars: Column, capital: Column, *, eta: float = 0.3, linear: bool = False) -> Column:
    """k of the impact k * |dw| ** 1.5, a share of capital; 0 under linear impact and where an input is not positive."""
    known = _positive(vol) & _positive(adv_dollars) & _positive(capital) & F.lit(not linear)
    return F.when(known, eta * vol * F.sqrt(capital / adv_dollars)).otherwise(0.0)


def cost_curvature(k: Column, traded: Column) -> Column:
    """Second derivative of k * |dw| ** 1.5 at a typical trade; null without impact or trade."""
    return F.when(_positive(k) & _positive(traded), 0.75 * k / F.sqrt(traded))


def annual_cost(cost: Column, held_days: Column, days: float = 252.0) -> Column:
    """A round trip's cost spread over its holding time, a year's worth."""
    return ratio(cost * days, held_days)


def borrow_carry(notional: Column, rate: float, steps: Column, per_year: float) -> Column:
    return F.when(notional < 0, -notional * rate * steps / per_year).otherwise(0.0)


def slippage_bps(side: Column, reference: Column, fill: Column) -> Column:
    """Basis points lost against the reference, positive when adverse."""
    sign = F.when(F.lower(side).isin("buy", "cover", "long"), 1.0).otherwise(-1.0)
    return sign * ratio(fill - reference, reference) * 1e4


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two ISO timestamps, null where one cannot be read."""
    return F.unix_millis(F.try_to_timestamp(end)) - F.unix_millis(F.try_to_timestamp(start))


def universe_key(symbols: Column) -> Column:
    """SHA-256 of the trimmed, upper-cased, distinct, sorted symbols joined by commas."""
    clean = F.transform(symbols, lambda s: F.upper(F.trim(s)))
    return F.sha2(F.concat_ws(",", F.array_sort(F.array_distinct(F.filter(clean, lambda s: s != "")))), 256)


def params_key(params: Column) -> Column:
    """SHA-256 of a map<string,double> whatever its order; numbers count to 9 decimals, -0 as 0."""
    entries = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.9f", F.round(e["value"], 9) + 0.0)))
    return F.sha2(F.concat_ws(";", entries), 256)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once however often it occurs."""
    return F.transform(F.array(value), use)[0]


def _tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 to double precision: Hart's rational function and a continued fraction, after West (2005)."""
    # The coefficients of numerator and denominator, highest power first.
    top = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    bottom = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

    def polynomial(coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * z + c
        return out

    fraction = z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))
    return F.exp(-z * z / 2) * F.when(z < 5 * math.sqrt(2), polynomial(top) / polynomial(bottom)).otherwise(1 / (fraction * math.sqrt(2 * math.pi)))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution, to double precision."""
    return _bound(x, lambda v: F.when(v > 0, 1 - _tail(F.least(v, F.lit(40.0)))).otherwise(_tail(F.least(-v, F.lit(40.0)))))


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution for 0 < p < 1, else null: a start good to 4.5e-4 and two of Newton's steps, error under 1e-9."""

    def solved(v: Column) -> Column:
        q = F.when((v > 0) & (v < 1), F.least(v, 1 - v))
        # The coefficients of the start (Abramowitz and Stegun 26.2.23).
        z = _bound(F.sqrt(-2 * F.ln(q)), lambda t: t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))
        for _ in range(2):
            z = _bound(z, lambda y: y + (F.when(y < 0, 1 - _tail(-y)).otherwise(_tail(y)) - q) * math.sqrt(2 * math.pi) * F.exp(y * y / 2))
        return F.when(v < 0.5, -z).otherwise(z)

    return _bound(p, solved)


def ir_standard_error(years: Column) -> Column:
    return ratio(F.lit(1.0), F.sqrt(years))


def predicted_ir(ic: Column, breadth: Column) -> Column:
    return ic * F.sqrt(breadth)


def shrink_level(ic: Column, periods: Column) -> Column:
    """How much of a measured IC to believe, from its t ratio: t2 / (1 + t2) with t2 = ic^2 * periods."""
    t2 = ic * ic * periods
    return t2 / (1 + t2)


def effective_size(n: Column, autocorrelation: Column) -> Column:
    """Independent observations among n with this lag-1 autocorrelation, 1 at least."""
    rho = F.least(F.greatest(autocorrelation, F.lit(0.0)), F.lit(0.999))
    return F.greatest(F.lit(1.0), n * (1 - rho) / (1 + rho))


@dataclass(frozen=True)
class Timeframe:
    """A bar length such as 5Min, 1Hour, 1Day or 1Week."""

    amount: int
    unit: str

    @staticmethod
    def parse(text: str) -> Timeframe:
        m = re.fullmatch(r"\s*(\d+)\s*(min|hour|day|week)s?\s*", text, re.I)
        if not m or int(m[1]) < 1:
            raise ValueError(f"no timeframe: {text!r}")
        return Timeframe(int(m[1]), m[2].lower())

    @property
    def minutes(self) -> float:
        return self.amount * {"min": 1, "hour": 60, "day": 24 * 60, "week": 7 * 24 * 60}[self.unit]

    @property
    def periods_per_year(self) -> float:
        """Of 252 trading days of 6.5 hours, or 52 weeks."""
        return {"min": 252 * 390, "hour": 252 * 6.5, "day": 252, "week": 52}[self.unit] / self.amount

    @property
    def interval(self) -> str:
        return f"INTERVAL {self.amount} {self.unit.upper().replace('MIN', 'MINUTE')}"
