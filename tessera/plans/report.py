"""Reports as bundles of DataFrames, and their rows on the driver for rendering.

A report's rows are collected only to render it: one row a file, which the reader of a table or a
markdown page has to read anyway.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.operators import crap, diff, merge, rollup
from tessera.sources import xml


@dataclass(frozen=True)
class Report:
    """lines: line_merged. files: file_cov. warnings: kind, file, line, detail and order. roots on the driver.
    found: how many documents there were."""

    lines: DataFrame
    files: DataFrame
    warnings: DataFrame
    roots: tuple[str, ...] = ()
    found: int = 0
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Frees what the report keeps cached; its frames are computed anew if used again."""
        for df in self.held:
            df.unpersist()

    @cached_property
    def total(self) -> Row:
        return rollup.report_rollup(self.files).first()

    def file_rows(self) -> list[Row]:
        """In document order."""
        return self.files.orderBy("doc_ord", "path").collect()

    def worst_first(self) -> list[Row]:
        return sorted(self.file_rows(), key=lambda f: -1.0 if f.line_rate is None else f.line_rate)

    @cached_property
    def warning_rows(self) -> list[Row]:
        return self.warnings.orderBy("phase", "report_ord", "class_pos", "line_pos", "file", "kind", "line", "detail").collect()

    def exclude(self, rules: Sequence[str], keep: Sequence[str] = ()) -> Report:
        """Without the files a rule matches; warnings and roots stay."""
        if not rules:
            return self
        return replace(self, files=rollup.exclude(self.files, rules, keep), lines=rollup.exclude(self.lines, rules, keep))

    def evaluate(self, min_line: float, min_branch: float = 0.0) -> rollup.Gate:
        return rollup.evaluate(rollup.report_rollup(self.files), min_line, min_branch)


@contextmanager
def cancellable(spark: SparkSession, group: str) -> Iterator[Callable[[], None]]:
    """Runs what is inside as one job group; calling what it yields, from any thread, cancels it."""
    context = spark.sparkContext
    context.setJobGroup(group, group, interruptOnCancel=True)
    try:
        yield lambda: context.cancelJobGroup(group)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def load(spark: SparkSession, files: list[str], max_chars: int = xml.MAX_CHARS) -> Report:
    """All documents merged, in the order given."""
    return merged(spark, xml.read_files(spark, files, max_chars), len(files))


def parse(spark: SparkSession, *texts: str, max_chars: int = xml.MAX_CHARS) -> Report:
    """Documents given as text, merged in the order given."""
    for t in texts:
        if problem := xml.problem(t.encode(), max_chars):
            raise xml.XmlError(problem)
    return merged(spark, spark.createDataFrame(list(enumerate(texts, 1)), "report_ord int, xml string"), len(texts))


def merged(spark: SparkSession, rows: DataFrame, count: int) -> Report:
    """count rows (report_ord from 1, xml) as one report."""
    docs = xml.parsed(rows).persist()
    scan = xml.scan(docs)
    found = merge.line_facts(scan.lines).persist()
    by_report = {r.report_ord: r.roots for r in scan.roots.collect()}
    roots = [by_report.get(k, []) for k in range(1, count + 1)]
    steps = spark.createDataFrame([(k + 1,) for k in merge.differing_steps(roots)], "report_ord int")
    lines = merge.merged_lines(found)
    seen = scan.files.groupBy("path").agg(F.min(F.struct("report_ord", "class_pos")).alias("doc_ord"))
    place = lambda df, phase: df.select(F.lit(phase).alias("phase"), "report_ord", *[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in ("class_pos", "line_pos")], "kind", "file", "line", "detail")
    warnings = place(scan.warnings, 0)
    for phase, df in ((1, merge.total_warnings(found)), (1, merge.condition_warnings(found)), (2, merge.identity_warnings(scan.files, steps))):
        warnings = warnings.unionByName(place(df, phase))
    kept = tuple(dict.fromkeys(r for own in roots for r in own))
    return Report(lines, rollup.file_rollup(lines, seen), warnings, kept, count, (docs, found))


def inputs(spark: SparkSession, path: str, pattern: str = xml.PATTERN) -> list[str]:
    """The files a path stands for: itself, or those of the pattern in the folder."""
    if xml.is_remote(path):
        return xml.remote_reports(spark, path, pattern)
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isfile(path):
        return [path]
    if os.path.isdir(path):
        return xml.find_reports(path, pattern)
    raise FileNotFoundError(f"No file or directory at '{path}'.")


def parse_path(spark: SparkSession, path: str, pattern: str = xml.PATTERN, max_chars: int = xml.MAX_CHARS) -> Report:
    return load(spark, inputs(spark, path, pattern), max_chars)


def parse_methods(spark: SparkSession, path: str, pattern: str = xml.PATTERN, max_chars: int = xml.MAX_CHARS) -> tuple[DataFrame, DataFrame]:
    """method_line and method_hdr of all documents of a path."""
    return xml.scan_methods(xml.parsed(xml.read_files(spark, inputs(spark, path, pattern), max_chars)).persist())


def parse_metrics(spark: SparkSession, path: str, max_chars: int = xml.MAX_CHARS) -> DataFrame:
    return xml.scan_metrics(xml.read_files(spark, [path], max_chars))


@dataclass(frozen=True)
class Difference:
    """files in their order; counts: how many lines of a path changed how. The changes themselves stay rows of
    changed until a document asks for lines."""

    files: list[Row]
    counts: dict[str, Row]
    changed: DataFrame
    before: float | None
    after: float | None

    @cached_property
    def lines(self) -> dict[str, list[Row]]:
        out: dict[str, list[Row]] = {}
        for r in diff.in_order(self.changed).toLocalIterator():
            out.setdefault(r.path, []).append(r)
        return out

    @property
    def delta(self) -> float | None:
        return None if self.before is None or self.after is None else self.after - self.before

    @property
    def line_count(self) -> int:
        return sum(r.newly_missed + r.newly_hit + r.added + r.removed for r in self.counts.values())


def compare(before: Report, after: Report) -> Difference:
    deltas = diff.file_deltas(before.files, after.files, list(before.roots) != list(after.roots))
    changed = diff.line_deltas(deltas, before.lines, after.lines)
    counts = {r.path: r for r in diff.change_counts(changed).collect()}
    return Difference(diff.ordered(deltas).collect(), counts, changed, before.total.line_rate, after.total.line_rate)


@dataclass(frozen=True)
class Risk:
    """The worst scored methods, how many there are and how many are above, unscored ones and unmatched members."""

    methods: list[Row]
    scored: int
    above: int
    unscored: list[Row]
    unmatched: list[str]
    most: float

    @property
    def outcome(self) -> str:
        return "NoData" if not self.scored else "Fail" if self.above else "Pass"

    @property
    def reason(self) -> str:
        n = self.scored
        if not n:
            if self.unscored:
                return f"{len(self.unscored)} methods have coverage but no usable complexity - supply --metrics <file> (dotnet msbuild /t:Metrics)"
            return "report carries no method-level data - nothing was measured per method"
        return f"{self.above} of {n} methods above threshold" if self.above else f"all {n} methods at or below threshold"


def risk(found: crap.Crap, most: float, top: int | None = None) -> Risk:
    """Counts are Spark's; only the methods shown (all without top) come to the driver."""
    unmatched = [] if found.unmatched is None else [r.display for r in found.unmatched.orderBy("pos").collect()]
    gate = crap.evaluate(found.methods, most).first()
    return Risk(crap.worst_first(found.methods, top).collect(), gate.scored, gate.above, found.unscored.orderBy("doc_ord").collect(), unmatched, most)
