"""Column expressions of the rule layer: range, step and flatline checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratusqc.constants import (
    CIRCULAR_VARIABLES,
    DEFAULT_SPECS,
    FLATLINE_TOLERANCE,
    OPEN_LIMITS,
    ZERO_EXEMPT_VARIABLES,
)


def finite(value: Column) -> Column:
    """True when a value can enter statistics: present and not NaN."""
    return value.isNotNull() & ~F.isnan(value)


LIMIT_FIELDS = (("min", "double"), ("max", "double"), ("step_max", "double"), ("persistence_max", "int"))


def spec_limits(specs: Column, variable: Column, defaults: dict = DEFAULT_SPECS) -> dict[str, Column]:
    """Limits that apply to a variable, by field.

    A station record replaces the default record as a whole; fields it leaves
    out become open limits, not the default's values.
    """
    own = F.try_element_at(specs, variable)
    has_own = F.coalesce(F.map_contains_key(specs, variable), F.lit(False))
    fields = {}
    for i, (name, kind) in enumerate(LIMIT_FIELDS):
        usual = F.create_map(*[F.lit(x) for v, spec in defaults.items() for x in (v, spec[i])])
        open_limit = F.lit(OPEN_LIMITS[i])
        fields[name] = (
            F.when(has_own, F.coalesce(own[name], open_limit))
            .otherwise(F.coalesce(F.try_element_at(usual, variable), open_limit))
            .cast(kind)
        )
    return fields


def range_violation(value: Column, low: Column, high: Column) -> Column:
    """NULL when fine, else what is wrong. NaN is tested first: Spark sorts it above all numbers."""
    infinite = F.abs(value) == F.lit(float("inf"))
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(value) | infinite, F.lit("non_finite_number"))
        .when(value < low, F.lit("below_min"))
        .when(value > high, F.lit("above_max"))
    )


def angular_delta(current: Column, previous: Column) -> Column:
    """Shortest way round a 360 degree circle."""
    turn = F.abs(current - previous) % F.lit(360.0)
    return F.least(turn, F.lit(360.0) - turn)


def step_delta(current: Column, previous: Column, circular: Column) -> Column:
    return F.when(circular, angular_delta(current, previous)).otherwise(F.abs(current - previous))


def step_fails(current: Column, previous: Column, step_max: Column, circular: Column) -> Column:
    delta = step_delta(current, previous, circular)
    return F.coalesce(
        finite(current) & finite(previous) & ~F.isnan(delta) & (delta > step_max), F.lit(False)
    )


def is_circular(variable: Column) -> Column:
    return variable.isin(*CIRCULAR_VARIABLES)


def zero_exempt(variable: Column) -> Column:
    return variable.isin(*ZERO_EXEMPT_VARIABLES)


def could_be_flat(newest: Column, before: Column, tolerance: float = FLATLINE_TOLERANCE) -> Column:
    """Cheap necessary condition of a flatline: its last two values nearly agree."""
    return F.abs(newest - before) < F.lit(2 * tolerance)


def flatline_fails(
    values: Column, newest: Column, count: Column, exempt_zero: Column, tolerance: float = FLATLINE_TOLERANCE
) -> Column:
    """True when the last ``count`` entries of ``values`` are all the oldest one of them.

    Any NULL or NaN among them passes; so does a run of zeros where zero is normal.
    ``values`` ends with ``newest`` and may be NULL where :func:`could_be_flat` is false.
    """
    recent = F.slice(values, -count, count)
    first = F.get(recent, F.lit(0))
    identical = F.forall(recent, lambda x: finite(x) & (F.abs(x - first) < F.lit(tolerance)))
    zeros = F.forall(recent, lambda x: F.abs(x) < F.lit(tolerance))
    alone = finite(newest) & ~(exempt_zero & (F.abs(newest) < F.lit(tolerance)))
    return F.coalesce(
        F.when(count == 1, alone).when(
            (count > 1) & values.isNotNull(),
            F.when(F.size(values) >= count, identical & ~(exempt_zero & zeros)),
        ),
        F.lit(False),
    )


def rule_outcome(range_code: Column, step: Column, flat: Column) -> Column:
    """First failing check wins; one struct of verdict, reason, fault and confidence."""

    def outcome(verdict, reason, fault, confidence):
        return F.struct(
            F.lit(verdict).alias("verdict"),
            F.lit(reason).alias("reason_code"),
            F.lit(fault).cast("string").alias("fault_type"),
            F.lit(confidence).alias("confidence"),
        )

    return (
        F.when(range_code.isNotNull(), outcome("anomalous", "RULE_RANGE_FAIL", "spike", 0.98))
        .when(step, outcome("anomalous", "RULE_STEP_FAIL", "spike", 0.95))
        .when(flat, outcome("anomalous", "RULE_PERSISTENCE_FAIL", "flatline", 0.95))
        .otherwise(outcome("valid", "VALID_READING", None, 1.0))
    )
