"""Scalar expressions: distances, number formats and text templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for part in parts[1:]:
        total = total + part * part
    return F.sqrt(total)


def general_format(x: str, digits: int = 6) -> str:
    """SQL for the number text of ``x`` with ``digits`` significant digits and no
    trailing zeros; plain notation for exponents from -4 up to ``digits``, else
    scientific."""
    exponent = f"floor(log10(abs({x})))"
    scale = f"pow(10D, {digits - 1} - {exponent})"
    rounded = f"rint(abs({x}) * {scale}) / {scale}"
    power = f"int(floor(log10({rounded}) + 1e-12))"
    trim = "regexp_replace(regexp_replace({}, '([.][0-9]*?)0+$', '$1'), '[.]$', '')"
    plain = trim.format(f"format_string('%.10f', {rounded})")
    mantissa = trim.format(f"format_string('%.{digits - 1}f', ({rounded}) / pow(10D, {power}))")
    tail = f"concat('e', IF({power} < 0, '-', '+'), lpad(string(abs({power})), 2, '0'))"
    return (
        f"CASE WHEN {x} = 0 THEN '0' ELSE concat(IF({x} < 0, '-', ''), "
        f"IF({power} >= -4 AND {power} < {digits}, {plain}, concat({mantissa}, {tail}))) END"
    )


def text_template(template: str) -> str:
    """SQL for a text with ``{expression}`` places.

    ``{x:g}`` gives six significant digits, ``{x:.2f}`` fixed decimals and
    ``{x:counts}`` the bracketed sizes of an array of (size, n): a size that
    occurs once or twice is written so often, others once with their number,
    so the text grows with the different sizes alone.
    """
    parts = []
    for i, piece in enumerate(re.split(r"\{([^{}]*)\}", template)):
        if i % 2 == 0:
            if piece:
                parts.append("'" + piece.replace("'", "\\'") + "'")
            continue
        expression, _, how = piece.partition(":")
        if how == "g":
            parts.append(general_format(expression))
        elif how == "counts":
            one = "IF(s.n <= 2, array_join(array_repeat(string(s.size), int(s.n)), ', '), concat(s.size, ' (', s.n, ' times)'))"
            parts.append(f"concat('[', array_join(transform({expression}, s -> {one}), ', '), ']')")
        elif how:
            parts.append(f"format_string('%{how}', {expression})")
        else:
            parts.append(f"string({expression})")
    return f"concat({', '.join(parts)})"
