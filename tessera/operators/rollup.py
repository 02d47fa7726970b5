"""Files and reports from merged lines; the gate; filters and orders of files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import excluded
from tessera.functions.rates import below, meets, rate

_SUMS = ("lines_hit", "lines_total", "branches_hit", "branches_total", "strict", "partial")


def classify() -> tuple[Column, Column]:
    """Lines hit in all their branches, and lines hit in some: aggregates over merged lines."""
    some = F.coalesce(F.col("cov") < F.col("tot"), F.lit(False))
    hit = F.col("hits") != 0
    return F.count_if(hit & ~some), F.count_if(hit & some)


def file_rollup(lines: DataFrame, seen: DataFrame | None = None, detail: bool = True) -> DataFrame:
    """A row a path. seen (path, doc_ord) adds files without lines and their order. detail: the uncovered
    lines and partial branches; without it the aggregation keeps counts only."""
    strict, partial = classify()
    lists = [
        F.sort_array(F.collect_list(F.when(F.col("hits") <= 0, F.col("line")))).alias("uncovered"),
        F.sort_array(F.collect_list(F.when(F.col("cov") < F.col("tot"), F.struct("line", F.col("cov").alias("covered"), F.col("tot").alias("total"))))).alias("partial_branches"),
    ]
    files = lines.groupBy("path").agg(
        F.count_if(F.col("hits") > 0).alias("lines_hit"), F.count("*").alias("lines_total"),
        F.coalesce(F.sum(F.col("cov").cast("long")), F.lit(0)).alias("branches_hit"), F.coalesce(F.sum(F.col("tot").cast("long")), F.lit(0)).alias("branches_total"),
        strict.alias("strict"), partial.alias("partial"), *(lists if detail else []),
    )
    if seen is not None:
        files = seen.join(files, "path", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in _SUMS})
    return with_rates(files)


def with_rates(files: DataFrame) -> DataFrame:
    pairs = (("line_rate", "lines_hit", "lines_total"), ("branch_rate", "branches_hit", "branches_total"), ("strict_rate", "strict", "lines_total"))
    return files.withColumns({name: rate(F.col(hit), F.col(total)) for name, hit, total in pairs})


def report_rollup(files: DataFrame) -> DataFrame:
    """One row: sums and ratios of sums over all files."""
    sums = files.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS])
    return with_rates(sums)


def exclude(files: DataFrame, rules: Sequence[str], keep: Sequence[str] = (), column: str = "path") -> DataFrame:
    """Without the rows whose path a rule matches; no rules: the same frame."""
    return files.filter(~excluded(F.col(column), rules, keep)) if rules else files


def below_percent(files: DataFrame, percent: float) -> DataFrame:
    return files.filter(below(F.col("line_rate"), percent))


def worst_first(files: DataFrame, tie: str = "doc_ord", top: int | None = None) -> DataFrame:
    """Unmeasured first, then by line rate; ties keep the order of the tie column."""
    rows = files.orderBy(F.coalesce(F.col("line_rate"), F.lit(-1.0)), tie)
    return rows if top is None else rows.limit(top)


def gate_columns(report: DataFrame, min_line: Column, min_branch: Column) -> DataFrame:
    """Adds outcome, reason and the verdict's rates to report rows."""
    line, branch = F.col("line_rate"), F.col("branch_rate")
    line_ok, branch_ok = meets(line, min_line), (min_branch <= 0) | F.coalesce(meets(branch, min_branch), F.lit(False))
    disabled, empty = (min_line <= 0) & (min_branch <= 0), F.col("lines_total") <= 0
    blind = (min_branch > 0) & (F.col("branches_total") <= 0)
    outcome = F.when(disabled, "Disabled").when(empty | blind, "NoData").when(line_ok & branch_ok, "Pass").otherwise("Fail")
    shown = F.regexp_replace(min_branch.cast("string"), r"\.0$", "")
    reason = (
        F.when(disabled, "no positive threshold - this gate cannot fail")
        .when(empty, "report carries no line data - nothing was measured")
        .when(blind, F.concat(F.lit("branch threshold of "), shown, F.lit("% requested but the report carries no branch data")))
        .when(line_ok & branch_ok, "thresholds met")
        .when(~line_ok & ~branch_ok, "line and branch coverage below threshold")
        .when(~line_ok, "line coverage below threshold")
        .otherwise("branch coverage below threshold")
    )
    return report.withColumns({"outcome": outcome, "reason": reason, "gate_line_rate": F.when(disabled | ~empty, line), "gate_branch_rate": F.when(disabled | ~(empty | blind), branch)})


@dataclass(frozen=True)
class Gate:
    """A verdict on the driver."""

    outcome: str
    line_rate: float | None
    branch_rate: float | None
    min_line: float
    min_branch: float
    reason: str

    @property
    def is_pass(self) -> bool:
        return self.outcome == "Pass"

    @property
    def is_inconclusive(self) -> bool:
        return self.outcome in ("NoData", "Disabled")

    @property
    def line_below(self) -> bool:
        return self.line_rate is not None and self.line_rate * 100 < self.min_line - 1e-9

    @property
    def branch_below(self) -> bool:
        return self.min_branch > 0 and self.branch_rate is not None and self.branch_rate * 100 < self.min_branch - 1e-9


def evaluate(report: DataFrame, min_line: float, min_branch: float = 0.0) -> Gate:
    """The gate's verdict on a one-row report."""
    r = gate_columns(report, F.lit(float(min_line)), F.lit(float(min_branch))).first()
    return Gate(r.outcome, r.gate_line_rate, r.gate_branch_rate, min_line, min_branch, r.reason)
