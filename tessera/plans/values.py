"""What texts from a command line or a build mean; None: nothing valid. Callers say so in their own words."""

from __future__ import annotations

import math
import re

FORMATS = ("table", "json", "markdown", "md")


def number(text: str) -> float | None:
    """A number; NaN is none, it would gate nothing."""
    try:
        value = float(text) if "_" not in text else math.nan
    except ValueError:
        return None
    return None if math.isnan(value) else value


def whole(text: str, least: int = 0) -> int | None:
    """A whole number of digits only, at least the least."""
    return int(text) if re.fullmatch("[0-9]+", text) and int(text) >= least else None


def output_format(text: str) -> str | None:
    """table, json or md."""
    return None if text not in FORMATS else "md" if text == "markdown" else text
