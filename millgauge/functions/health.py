"""Machine health: score, urgency classes and gauge bands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# Penalty points and limits of the health score, and class limits.
@dataclass(frozen=True)
class HealthLimits:
    wear_limit: float = 80
    wear_penalty: int = 30
    vibration_limit: float = 4.0
    vibration_penalty: int = 25
    temperature_limit: float = 80
    temperature_penalty: int = 20
    coolant_minimum: float = 3.0
    coolant_penalty: int = 15
    anomaly_penalty: int = 10
    critical_score: float = 40
    warning_score: float = 65
    critical_wear: float = 90
    warning_wear: float = 75


DEFAULT_LIMITS = HealthLimits()


def _penalty(condition: Column, points: int) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0))


def health_score(
    wear: Column,
    vibration: Column,
    temperature: Column,
    coolant: Column,
    machine_status: Column,
    anomaly: Column,
    limits: HealthLimits = DEFAULT_LIMITS,
) -> Column:
    """100 minus penalty points, never below 0; unknown readings cost nothing."""
    starved = (coolant < limits.coolant_minimum) & (machine_status == "Running")
    lost = (
        _penalty(wear > limits.wear_limit, limits.wear_penalty)
        + _penalty(vibration > limits.vibration_limit, limits.vibration_penalty)
        + _penalty(temperature > limits.temperature_limit, limits.temperature_penalty)
        + _penalty(starved, limits.coolant_penalty)
        + _penalty(anomaly, limits.anomaly_penalty)
    )
    return F.greatest(F.lit(0), F.lit(100) - lost)


def urgency(worst_score: Column, peak_wear: Column, limits: HealthLimits = DEFAULT_LIMITS) -> Column:
    """Critical / Warning / Normal from the lowest score and the highest wear."""
    critical = (worst_score < limits.critical_score) | (peak_wear > limits.critical_wear)
    warning = (worst_score < limits.warning_score) | (peak_wear > limits.warning_wear)
    return F.when(critical, "Critical").when(warning, "Warning").otherwise("Normal")


def score_class(score: Column, limits: HealthLimits = DEFAULT_LIMITS) -> Column:
    """The same three classes from an average score alone."""
    return (
        F.when(score < limits.critical_score, "Critical")
        .when(score < limits.warning_score, "Warning")
        .otherwise("Normal")
    )


def urgency_order(label: Column) -> Column:
    return F.when(label == "Critical", 1).when(label == "Warning", 2).otherwise(3)


def _band(good: Column, fair: Column) -> Column:
    return F.when(good, "green").when(fair, "amber").otherwise("red")


# Gauge bands. A missing reading counts as 0, as on the inspector's gauges.
def health_band(score: Column) -> Column:
    score = F.coalesce(score, F.lit(0))
    return _band(score >= 70, score >= 40)


def temperature_band(celsius: Column) -> Column:
    celsius = F.coalesce(celsius, F.lit(0.0))
    return _band(celsius < 80, celsius < 100)


def vibration_band(mm_s: Column) -> Column:
    mm_s = F.coalesce(mm_s, F.lit(0.0))
    return _band(mm_s < 3, mm_s < 5)


def wear_band(percent: Column) -> Column:
    percent = F.coalesce(percent, F.lit(0.0))
    return _band(percent < 60, percent < 80)


def availability_band(hours: Column) -> Column:
    hours = F.coalesce(hours, F.lit(0.0))
    return _band(hours > 4, hours > 0)
