"""A build step: load, exclude, render, summarize, and fail unless the gate passes.

The messages of refusals are fixed values.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tessera.functions.paths import WELL_KNOWN
from tessera.plans import report as reports
from tessera.plans import values
from tessera.sinks import documents, render
from tessera.sources.xml import MAX_CHARS, PATTERN, find_reports


class BuildFailed(Exception):
    """The step's reason to fail."""


def threshold(value: str, name: str) -> float:
    if (found := values.number(value)) is None:
        raise ValueError(f"Invalid {name}: '{value}' (expected a number).")
    return found


def flag(value: str, name: str) -> bool:
    word = value.strip().lower()
    if word not in ("true", "false"):
        raise ValueError(f"Invalid {name}: '{value}' (expected 'true' or 'false').")
    return word == "true"


def max_chars(value: str, name: str) -> int:
    if (found := values.whole(value)) is None:
        raise ValueError(f"Invalid {name}: '{value}' (expected a non-negative integer; 0 = no cap).")
    return found


def output_format(value: str, name: str) -> str:
    if (found := values.output_format(value)) is None:
        raise ValueError(f"Invalid {name}: '{value}' (expected 'table', 'json', 'markdown', or 'md').")
    return "markdown" if found == "md" else found


@dataclass(frozen=True)
class Config:
    """Parameters as a build passes them: text. Subclasses or instances override what they need."""

    folder: str = "TestResults"
    min_line: str = "80"
    min_branch: str = "0"
    format: str = "table"
    exclude_generated: str = "false"
    pattern: str = PATTERN
    max_chars: str = str(MAX_CHARS)


def load_report(spark: SparkSession, folder: str, pattern: str = PATTERN, most: int = MAX_CHARS) -> reports.Report | None:
    """The folder's reports merged; None if there is no folder or no file of the pattern."""
    if not os.path.isdir(folder):
        return None
    files = find_reports(folder, pattern)
    return reports.load(spark, files, most) if files else None


def report_coverage(spark: SparkSession, config: Config, tell: Callable[[str], object] = print) -> None:
    """Renders the folder's coverage and its summary; raises BuildFailed without files or without a pass."""
    found = load_report(spark, config.folder, config.pattern, max_chars(config.max_chars, "Coverage max_chars"))
    if found is None:
        raise BuildFailed(f"No files matching '{config.pattern}' found in {config.folder}")
    if flag(config.exclude_generated, "Coverage exclude_generated"):
        found = found.exclude(WELL_KNOWN)
    gate = found.evaluate(threshold(config.min_line, "Coverage min_line"), threshold(config.min_branch, "Coverage min_branch"))
    page = render.gate_markdown(found, gate)
    shown = {"json": lambda: documents.report_json(found), "markdown": lambda: page, "table": lambda: render.report_table(found)}
    tell(shown[output_format(config.format, "Coverage format")]())
    if warning := documents.append_summary(os.environ.get("GITHUB_STEP_SUMMARY"), page):
        tell(warning)
    found.release()
    if not gate.is_pass:
        raise BuildFailed(render.gate_line(gate))
