"""Number helpers of the rule set, as Spark SQL expression text.

Expressions are built as text because one parsed expression costs the driver one call, however large it is.

Shown numbers are IEEE doubles rounded half to even on the exact binary value: 63.125 as 63.12 and 1.005 as 1.00.
Spark's ``round`` and ``format_string`` work on the shortest decimal text instead (63.13 and 1.01), so
``fixed_text`` settles ties itself, with built-in expressions.
"""

from __future__ import annotations


def to_double(value: str) -> str:
    """NULL counts as zero everywhere in the rules."""
    return f"coalesce(cast({value} AS double), 0D)"


def ratio(numerator: str, divisor: str) -> str:
    """``numerator / divisor``, NULL unless the divisor is positive."""
    return f"CASE WHEN {divisor} > 0 THEN {numerator} / {divisor} END"


def _distance_from_tie(magnitude: str, digits: int) -> str:
    """Exact sign of ``magnitude * 2 * 10**digits`` minus the odd whole number next to it.

    The factor is split into powers of two, whose products with a double are exact.  Whole parts are taken off
    first and the piece with the finest grain is added last, so that no addition rounds.
    """
    factor = 2 * 10**digits
    powers = [1 << bit for bit in reversed(range(factor.bit_length())) if factor >> bit & 1]
    pieces = [f"{magnitude} * {power}D" for power in powers]
    wholes = " + ".join(f"floor({piece})" for piece in pieces)
    fractions = [f"({piece} - floor({piece}))" for piece in pieces]
    tie = f"rint({magnitude} * {factor}D)"
    return f"(({' + '.join(fractions[:-1])}) - ({tie} - ({wholes}))) + {fractions[-1]}"


def fixed_text(value: str, digits: int) -> str:
    """Text of a double with exactly ``digits`` places; pass a plain column, the value is used many times.

    Ties are rare, so their arithmetic sits in a lambda that binds the value once.  The lambda also keeps the
    projection out of whole-stage code generation; otherwise all rules end up in one generated method that is too
    large for the JVM to compile, which makes them several times slower.
    """
    shortest = f"try_cast(abs({value}) AS decimal(38,16))"
    away = f"round({shortest}, {digits})"
    step = f"{10.0**-digits:.{digits}f}"
    half = f"{0.5 * 10.0**-digits:.{digits + 1}f}"
    distance = _distance_from_tie("abs(x)", digits)
    side = f"element_at(transform(array({value}), x -> {distance}), 1)"
    rounded = f"""CASE
        WHEN {away} - {shortest} <> {half} THEN {away}
        ELSE CASE signum({side}) WHEN 1D THEN {away} WHEN -1D THEN {away} - {step}
            ELSE bround({shortest}, {digits}) END END"""
    signed = f"CASE WHEN {value} < 0 THEN -1 ELSE 1 END * cast({rounded} AS decimal(30,{digits}))"
    beyond_decimal = f"format_string('%.{digits}f', {value})"
    return f"CASE WHEN {value} IS NOT NULL THEN coalesce(cast({signed} AS string), {beyond_decimal}) END"
