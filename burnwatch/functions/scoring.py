"""Change, severity and risk rules."""

from __future__ import annotations


def at_most(value: str, ceiling: str) -> str:
    """``value <= ceiling`` where a missing side counts as not met."""
    return f"coalesce({value} <= {ceiling}, false)"


def exceeds(value: str, floor: str) -> str:
    """``value > floor`` where a missing side counts as no."""
    return f"coalesce({value} > {floor}, false)"


def percent_change(baseline: str, current: str) -> str:
    """Change in percent; from a zero baseline any rise is 100 and anything else 0."""
    from_zero = f"CASE WHEN {current} > 0 THEN 100D ELSE 0D END"
    return f"CASE WHEN {baseline} = 0 THEN {from_zero} ELSE try_divide({current} - {baseline}, {baseline}) * 100 END"


def change_severity(error_change: str, *others: str) -> str:
    largest = f"greatest({', '.join((error_change, *others))})"
    return (
        f"CASE WHEN {error_change} IS NULL THEN 'minor' WHEN {largest} > 100 THEN 'critical'"
        f" WHEN {largest} > 50 THEN 'warning' ELSE 'minor' END"
    )


def burn_severity(burn: str) -> str:
    return (
        f"CASE WHEN {burn} < 1 THEN 'healthy' WHEN {burn} < 2 THEN 'warning'"
        f" WHEN {burn} < 10 THEN 'critical' ELSE 'emergency' END"
    )


def risk_level(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 70 THEN 'critical' WHEN {score} >= 50 THEN 'high'"
        f" WHEN {score} >= 30 THEN 'medium' ELSE 'low' END"
    )


def ratio_or_zero(numerator: str, denominator: str) -> str:
    """``numerator / denominator``, and 0 unless the denominator is positive."""
    return f"(CASE WHEN {denominator} > 0 THEN try_divide({numerator}, {denominator}) ELSE 0D END)"


def fixed(value: str, digits: int) -> str:
    """Text with a fixed number of decimals; a missing number reads ``nan``."""
    return f"CASE WHEN {value} IS NULL THEN 'nan' ELSE format_string('%.{digits}f', {value}) END"


def sentence(*parts: str) -> str:
    """Concatenation of expressions; give literal text through ``words``."""
    return f"concat({', '.join(parts)})"


def words(text: str) -> str:
    return f"'{text}'"


def or_zero(value: str) -> str:
    return f"coalesce({value}, 0D)"


def or_zero_count(value: str) -> str:
    return f"coalesce(CAST({value} AS BIGINT), 0L)"
