"""Scalar diagnostics as column expressions: thermodynamics, levels, classes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: R/cp and the Bolton constants.
RD_CP = 0.2854
EPSILON = 0.622
INTENSITY_THRESHOLDS = (1.0, 10.0, 20.0, 50.0, 100.0)
INTENSITY_LABELS = ("dry", "light", "moderate", "heavy", "very_heavy", "extreme")
ERROR_LABELS = ("underestimate_severe", "underestimate_moderate", "near_zero", "overestimate_moderate", "overestimate_severe")
DROUGHT_CUTS = ((-2.0, "extreme drought"), (-1.5, "severe drought"), (-1.0, "moderate drought"), (1.0, "near normal"), (1.5, "moderately wet"), (2.0, "severely wet"))


def checked(value: Column, holds: Column, message: str) -> Column:
    """The value, or an error at run time where the condition is false; null passes."""
    return F.when(F.coalesce(~holds, F.lit(False)), F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def saturation_vapor_pressure(temperature: Column) -> Column:
    """Pa from K (Bolton)."""
    celsius = temperature - F.lit(273.15)
    return F.lit(611.2) * F.exp(F.lit(17.67) * celsius / (celsius + F.lit(243.5)))


def specific_humidity_from_rh(temperature: Column, pressure: Column, relative_humidity: Column) -> Column:
    """kg/kg from K, Pa and a fraction; a fraction outside 0 to 1 raises at run time."""
    vapor = checked(relative_humidity, relative_humidity.between(0, 1), "relative_humidity must be between 0 and 1") * saturation_vapor_pressure(temperature)
    return F.lit(EPSILON) * vapor / (pressure - F.lit(1.0 - EPSILON) * vapor)


def potential_temperature(temperature: Column, pressure: Column, p0: float = 100000.0) -> Column:
    return temperature * F.pow(F.lit(p0) / pressure, F.lit(RD_CP))


def equivalent_potential_temperature(temperature: Column, pressure: Column, specific_humidity: Column, p0: float = 100000.0) -> Column:
    """K (Bolton); needs positive temperature and pressure and 0 <= q < 1."""
    t = checked(temperature, (temperature > 0) & (pressure > 0), "temperature and pressure must be positive")
    q = checked(specific_humidity, (specific_humidity >= 0) & (specific_humidity < 1), "specific_humidity must satisfy 0 <= q < 1")
    mixing = q / (F.lit(1.0) - q)
    vapor = mixing * pressure / (F.lit(EPSILON) + mixing) / 100.0
    condensation = F.lit(1.0) / (F.lit(1.0) / (t - 55.0) - F.log(vapor / 6.112) / 2840.0) + 55.0
    dry = t * F.pow(F.lit(p0) / pressure, F.lit(RD_CP) * (F.lit(1.0) - mixing * 0.28))
    return dry * F.exp((F.lit(3036.0) / condensation - 1.78) * mixing * (F.lit(1.0) + mixing * 0.448))


def gev_return_level(shape: Column, loc: Column, scale: Column, return_period: Column) -> Column:
    """loc + scale / shape (L ** -shape - 1), L = -ln(1 - 1/T); the Gumbel limit near shape 0."""
    checked_scale = checked(scale, (return_period > 1) & (scale > 0), "return_period must be over 1 and scale positive")
    level = -F.log(F.lit(1.0) - F.lit(1.0) / return_period)
    return F.when(F.abs(shape) < 1e-8, loc - checked_scale * F.log(level)).otherwise(loc + checked_scale / shape * (F.pow(level, -shape) - 1.0))


def pot_return_level(threshold: Column, shape: Column, scale: Column, rate: Column, return_period: Column) -> Column:
    """u + scale / shape ((rate T) ** shape - 1); null where rate * T <= 1 or the scale is not positive."""
    many = rate * return_period
    level = F.when(F.abs(shape) < 1e-8, threshold + scale * F.log(many)).otherwise(threshold + scale / shape * (F.pow(many, shape) - 1.0))
    return F.when((many > 1) & (scale > 0), level)


def return_level(threshold: float, shape: float, scale: float, rate: float, return_period: float) -> float:
    """The same for numbers; impossible arguments raise."""
    if not (scale > 0 and rate > 0 and return_period > 0 and rate * return_period > 1):
        raise ValueError("scale, rate and return_period must be positive and rate * return_period over 1")
    many = rate * return_period
    return threshold + (scale * math.log(many) if abs(shape) < 1e-8 else scale / shape * (many**shape - 1))


def intensity_class(observation: Column, thresholds: Sequence[float] = INTENSITY_THRESHOLDS, labels: Sequence[str] = INTENSITY_LABELS) -> Column:
    """The label of the left-closed bin; null gets the last label."""
    if list(thresholds) != sorted(set(thresholds)) or len(labels) != len(thresholds) + 1:
        raise ValueError("thresholds must increase and there must be one more label")
    out = None
    for t, label in zip(thresholds, labels, strict=False):
        out = F.when(observation < t, label) if out is None else out.when(observation < t, label)
    return out.otherwise(labels[-1])


def error_class(observation: Column, prediction: Column, *, relative_thresholds: tuple[float, float] = (0.25, 0.5), absolute_tolerance: float = 1.0, labels: Sequence[str] = ERROR_LABELS) -> Column:
    """Five classes by relative error, or by error where |observation| is within the tolerance; null is near zero."""
    moderate, severe = relative_thresholds
    error = prediction - observation
    measure = F.when(F.abs(observation) > absolute_tolerance, error / F.abs(observation)).otherwise(error)
    return F.when(measure <= -severe, labels[0]).when(measure < -moderate, labels[1]).when(measure >= severe, labels[4]).when(measure > moderate, labels[3]).otherwise(labels[2])


def drought_category(index: Column, null_label: str | None = "extremely wet") -> Column:
    """The class of a standardised index; a null one gets ``null_label``."""
    out = F.when(index.isNull(), F.lit(null_label))
    for cut, label in DROUGHT_CUTS:
        out = out.when(index < cut if cut >= 1.0 else index <= cut, label)
    return out.otherwise("extremely wet")


def cosine_weight(latitude: Column) -> Column:
    return checked(F.cos(F.radians(latitude)), F.abs(latitude) <= 90, "latitude must lie between -90 and 90 degrees")


def longitude(value: Column, *, target: str | None = None, center: float = 0.0) -> Column:
    """Degrees in [-180, 180] (180 stays positive) or [0, 360): by target '-180_180' / '0_360' or by center 0 / 180."""
    form = target or {0.0: "-180_180", 180.0: "0_360"}.get(float(center))
    if form == "0_360":
        return F.pmod(value, F.lit(360.0))
    if form != "-180_180":
        raise ValueError("target must be '-180_180' or '0_360', center 0 or 180")
    wrapped = F.pmod(value + 180.0, F.lit(360.0)) - 180.0
    return F.when((wrapped == -180.0) & (value > 0), 180.0).otherwise(wrapped)


def nested_grid_spacing(parent_dx: float, ratios: Sequence[int]) -> list[float]:
    """Grid spacings of nested domains."""
    if parent_dx <= 0 or any(int(r) != r or r < 1 for r in ratios):
        raise ValueError("parent_dx must be positive and the ratios positive integers")
    out = [float(parent_dx)]
    for r in ratios:
        out.append(out[-1] / r)
    return out
