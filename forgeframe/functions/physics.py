"""Physical and numerical formulas over columns. Nulls give nulls unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MATRIX_DENSITY = 1.20
# Units of energy, in hartree.
HARTREE = {1.0: ["hartree", "ha"], 2625.499638: ["kj/mol", "kjmol", "kj"], 627.509474: ["kcal/mol", "kcalmol", "kcal"]}
#: Abramowitz and Stegun 7.1.26: the error function to 1.5e-7.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def finite(x: Column) -> Column:
    """The value, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def finite_or_zero(x: Column) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x held within the bounds; unlike least and greatest, null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def away_from_zero(x: Column, least: float = 1e-8) -> Column:
    return F.when(F.abs(x) < least, F.lit(least)).otherwise(x)


def largest_conversion(ratio: Column) -> Column:
    """min(1, r, 1/r) for a finite r above 0, else 1."""
    return F.coalesce(F.when(finite(ratio) > 0, F.least(F.lit(1.0), ratio, F.try_divide(F.lit(1.0), ratio))), F.lit(1.0))


def glass_transition(tg0, tg_inf, lam, conversion) -> Column:
    """DiBenedetto's glass transition temperature at a conversion."""
    tg0, tg_inf, lam, a = map(_c, (tg0, tg_inf, lam, conversion))
    return tg0 + (tg_inf - tg0) * (lam * a) / away_from_zero(1.0 - (1.0 - lam) * a)


def composite_modulus(matrix, filler, shape, volume_fraction) -> Column:
    """Halpin-Tsai modulus of a filled matrix."""
    m, f, xi, v = map(_c, (matrix, filler, shape, volume_fraction))
    m = F.when(m <= 1e-12, F.lit(1e-12)).otherwise(m)
    ratio = f / m
    eta = (ratio - 1.0) / (ratio + xi + 1e-12)
    return m * (1.0 + xi * eta * v) / away_from_zero(1.0 - eta * v)


def volume_fraction(weight_fraction, filler_density, matrix_density=MATRIX_DENSITY) -> Column:
    w, rho, rho_m = map(_c, (weight_fraction, filler_density, matrix_density))
    part = w / F.when(rho <= 1e-12, F.lit(1e-12)).otherwise(rho)
    return clamp(part / away_from_zero(part + (1.0 - w) / rho_m, 1e-12))


def stoichiometry(resin_weight, epoxides, hardener_weight, hydrogens, given=None, given_as: str = "phr") -> Column:
    """Equivalent weights and parts per hundred. ``given``: the used amount, as ``phr`` or as ``r/h`` (resin to hardener)."""
    mr, fr, mh, fh = map(_c, (resin_weight, epoxides, hardener_weight, hydrogens))
    eew = F.when(fr > 0, F.try_divide(mr, fr)).otherwise(mr)
    ahew = F.when(fh > 0, F.try_divide(mh, fh)).otherwise(mh)
    theory = F.when(eew > 0, F.try_divide(ahew, eew) * 100).otherwise(0.0)
    actual = theory
    if given is not None:
        used = F.try_divide(F.lit(100.0), given) if given_as == "r/h" else given
        actual = F.when(given > 0, used).otherwise(theory)
    ratio = F.when(theory > 0, F.try_divide(actual, theory)).otherwise(0.0)
    return F.struct(eew.alias("eew"), ahew.alias("ahew"), theory.alias("theoretical_phr"), actual.alias("actual_phr"), ratio.alias("stoich_ratio"), (actual - theory).alias("stoich_delta"))


def energy(hartree: Column, unit: Column) -> Column:
    """An energy in hartree in another unit; unknown units leave it as it is."""
    out = F
    for factor, names in HARTREE.items():
        out = out.when(F.lower(unit).isin(names), finite(hartree) * factor)
    return out.otherwise(finite(hartree))


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = t * (ERF[0] + t * (ERF[1] + t * (ERF[2] + t * (ERF[3] + t * ERF[4]))))
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / math.sqrt(2)))


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def acquisition(kind: str, mu: Column, sigma: Column, best=None, kappa: float = 2.0, xi: float = 0.01, maximise: bool = True) -> Column:
    """How much a candidate is worth trying: ``uncertainty``, ``ucb`` or ``ei`` (expected improvement on ``best``)."""
    sigma = F.greatest(sigma, F.lit(1e-12))
    if kind == "uncertainty":
        return sigma
    if kind == "ucb":
        return mu + kappa * sigma if maximise else -(mu - kappa * sigma)
    if kind == "ei":
        gain = (mu - _c(best) if maximise else _c(best) - mu) - xi
        return gain * normal_cdf(gain / sigma) + sigma * normal_pdf(gain / sigma)
    raise ValueError(f"no acquisition named {kind}")


def positional_encoding(position: Column, width: int) -> Column:
    """Sines (even components) and cosines (odd ones) of a position at falling rates."""
    angle = [position / 10000 ** (2 * (i // 2) / width) for i in range(width)]
    return F.array(*[F.cos(a) if i % 2 else F.sin(a) for i, a in enumerate(angle)])


def positional_encoding_2d(row: Column, column: Column, width: int) -> Column:
    return F.concat(positional_encoding(row, width // 2), positional_encoding(column, width // 2))


def warm_up_rate(step: Column, width: int, warm_up: int = 4000) -> Column:
    """Learning rate that rises to ``warm_up`` steps, then falls with the root of the step."""
    return 1 / math.sqrt(width) * F.least(F.pow(step, F.lit(-0.5)), step * F.lit(float(warm_up)) ** -1.5)
