"""Commands: report, check, crap, diff, snapshot, version, help. Exit codes: 0 good; 1 failed, inconclusive or not run; 2 unknown.

Flags, exit codes and the messages of refusals are fixed values that scripts rely on.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tessera.functions.paths import WELL_KNOWN
from tessera.operators import crap, rollup
from tessera.plans import report as reports
from tessera.plans import values
from tessera.sinks import documents, render
from tessera.sinks.text import colours, pct
from tessera.sources.xml import MAX_CHARS, PATTERN, XmlError

VERSION = "0.1.0"
FLAGS = {"exclude-generated", "github-summary"}
USAGE = """tessera - coverage reports on Spark

  report   <path> [--format table|json|md] [--threshold N]
  check    <path> [--min-line N] [--min-branch N]
  crap     <path> [--metrics FILE] [--max-crap N] [--top N] [--format table|json|md]
  diff     <before> <after> [--format table|json|md]
  snapshot <path> [--commit SHA] [--branch NAME] [--project NAME]
  version

<path> is a file or a folder. Everywhere: --pattern NAME|**/NAME (default **/coverage.cobertura.xml),
--max-chars N (default 50000000, 0: any). Except in diff: --exclude-generated [--keep a,b],
--upload URL (report, check, snapshot), --github-summary (report, check, crap).
Exit codes: 0 good, 1 failed or inconclusive or not run, 2 unknown command.
"""


class Refused(Exception):
    """An argument is wrong: the message is all there is to say."""


def parse_args(raw: list[str]) -> tuple[str, dict[str, str]]:
    """Command and options by lower-case name; bare words are file, or before and after."""
    if not raw:
        return "help", {}
    command, options, waiting, bare = raw[0], {}, None, 0
    for word in raw[1:]:
        if word.startswith("--"):
            if waiting is not None:
                options[waiting] = "true"
            waiting = word[2:].lower()
            if waiting in FLAGS:
                options[waiting], waiting = "true", None
        elif waiting is not None:
            options[waiting], waiting = word, None
        else:
            options[{0: "before" if command == "diff" else "file", 1: "after"}.get(bare, f"arg{bare}")] = word
            bare += 1
    if waiting is not None:
        options[waiting] = "true"
    return command, options


def number(options: dict[str, str], name: str, default: str | None = None) -> float | None:
    raw = options.get(name, default)
    if raw is None:
        return None
    value = values.number(raw)
    if value is None:
        raise Refused(f"Invalid --{name} value: '{raw}' (expected a number).")
    return value


def digits(options: dict[str, str], name: str, least: int, expected: str) -> int | None:
    raw = options.get(name)
    if raw is None:
        return None
    value = values.whole(raw, least)
    if value is None:
        raise Refused(f"Invalid --{name} value: '{raw}' (expected {expected}).")
    return value


def output_format(options: dict[str, str]) -> str:
    raw = options.get("format", "table")
    value = values.output_format(raw)
    if value is None:
        raise Refused(f"Invalid --format value: '{raw}' (expected table, json, markdown, or md).")
    return value


def needed(options: dict[str, str], *names: str, usage: str) -> list[str]:
    if not all(n in options for n in names):
        raise Refused(f"Usage: tessera {usage}")
    return [options[n] for n in names]


def scope(options: dict[str, str]) -> tuple[str, int]:
    most = digits(options, "max-chars", 0, "a non-negative integer; 0 = no cap")
    return options.get("pattern", PATTERN), MAX_CHARS if most is None else most


def exclusions(options: dict[str, str]) -> tuple[tuple[str, ...], list[str]]:
    keep = [k.strip() for k in options.get("keep", "").split(",") if k.strip()]
    return (WELL_KNOWN if "exclude-generated" in options else ()), keep


class Cli:
    def __init__(self, spark: Callable[[], SparkSession], out: TextIO, err: TextIO, colour: bool = False) -> None:
        self.spark, self.out, self.err, self.colour = spark, out, err, colour
        self.held: list[reports.Report] = []

    def run(self, args: list[str]) -> int:
        command, options = parse_args(args)
        known = {"report": self.report, "check": self.check, "crap": self.crap, "diff": self.diff, "snapshot": self.snapshot}
        if command == "version":
            self.out.write(f"tessera {VERSION}\n")
            return 0
        if command in ("help", "--help", "-h"):
            self.out.write(USAGE)
            return 0
        if command not in known:
            self.err.write(f"Unknown command '{command}'.\n")
            self.out.write(USAGE)
            return 2
        try:
            return known[command](options)
        except Refused as e:
            self.err.write(f"{e}\n")
        except (XmlError, ValueError, OSError) as e:
            self.err.write(f"error: {e}\n")
        except PySparkException as e:
            self.err.write(f"error: {str(e).splitlines()[0]}\n")
        finally:
            while self.held:
                self.held.pop().release()
        return 1

    def _load(self, path: str, options: dict[str, str], exclude: bool = True) -> reports.Report:
        pattern, most = scope(options)
        found = reports.parse_path(self.spark(), path, pattern, most)
        self.held.append(found)
        return found.exclude(*exclusions(options)) if exclude else found

    def _summary(self, options: dict[str, str], page: Callable[[], str]) -> None:
        if "github-summary" in options and (warning := documents.append_summary(os.environ.get("GITHUB_STEP_SUMMARY"), page())):
            self.err.write(warning + "\n")

    def _upload(self, options: dict[str, str], document: Callable[[], str]) -> int:
        if "upload" not in options:
            return 0
        good, told = documents.upload(options["upload"], document)
        self.err.write(told + "\n")
        return 0 if good else 1

    def report(self, options: dict[str, str]) -> int:
        (path,) = needed(options, "file", usage="report <path> [--format table|json|md] [--threshold N] [--exclude-generated]")
        kind, threshold = output_format(options), number(options, "threshold")
        found = self._load(path, options)
        shown = {"json": lambda: documents.report_json(found), "md": lambda: render.report_markdown(found, threshold)}
        self.out.write(shown.get(kind, lambda: render.report_table(found, self.colour))())
        self._summary(options, lambda: render.report_markdown(found, threshold))
        return self._upload(options, lambda: documents.report_json(found))

    def check(self, options: dict[str, str]) -> int:
        (path,) = needed(options, "file", usage="check <path> --min-line N [--min-branch N] [--exclude-generated]")
        min_line, min_branch = number(options, "min-line", "80"), number(options, "min-branch", "0")
        found = self._load(path, options)
        gate = found.evaluate(min_line, min_branch)
        self._summary(options, lambda: render.gate_markdown(found, gate))
        (self.out if gate.is_pass else self.err).write(render.gate_line(gate) + "\n")
        if not gate.is_pass and gate.line_below:
            self.err.write("files below line threshold:\n")
            for f in rollup.below_percent(found.files, min_line).orderBy("doc_ord", "path").collect():
                self.err.write(f"  {f.path}: {pct(f.line_rate, True)}\n")
        sent = self._upload(options, lambda: documents.report_json(found))
        return sent if gate.is_pass else 1

    def crap(self, options: dict[str, str]) -> int:
        (path,) = needed(options, "file", usage="crap <path> [--metrics <file>] [--max-crap N] [--top N] [--format table|json|md]")
        kind, most, top = output_format(options), number(options, "max-crap", "6"), digits(options, "top", 1, "a positive integer")
        pattern, chars = scope(options)
        rules, keep = exclusions(options)
        lines, headers = (rollup.exclude(df, rules, keep, "file") for df in reports.parse_methods(self.spark(), path, pattern, chars))
        members = None
        if "metrics" in options:
            if not os.path.isfile(options["metrics"]):
                raise FileNotFoundError(f"No metrics file at '{options['metrics']}'.")
            members = reports.parse_metrics(self.spark(), options["metrics"], chars)
        risk = reports.risk(crap.analyze(lines, headers, members), most, top)
        shown = {"json": lambda: documents.risk_json(risk, top), "md": lambda: render.risk_markdown(risk, top)}
        self.out.write(shown.get(kind, lambda: render.risk_table(risk, top, self.colour))())
        self._summary(options, lambda: render.risk_markdown(risk, top))
        good = risk.outcome == "Pass"
        (self.out if good else self.err).write(render.risk_line(risk) + "\n")
        return 0 if good else 1

    def diff(self, options: dict[str, str]) -> int:
        before, after = needed(options, "before", "after", usage="diff <before> <after> [--format table|json|md]")
        kind = output_format(options)
        found = reports.compare(self._load(before, options, False), self._load(after, options, False))
        shown = {"json": lambda: documents.diff_json(found), "md": lambda: render.diff_markdown(found)}
        self.out.write(shown.get(kind, lambda: render.diff_table(found, self.colour))())
        return 0

    def snapshot(self, options: dict[str, str]) -> int:
        (path,) = needed(options, "file", usage="snapshot <path> [--commit <sha>] [--branch <branch>] [--project <name>]")
        found = self._load(path, options)
        missing = [f"--{k}" for k in ("commit", "branch", "project") if k not in options]
        own = documents.file_hash(path) if os.path.isfile(path) else None
        text = documents.snapshot_json(found, *(options.get(k, "unknown") for k in ("commit", "branch", "project")), own)
        if missing:
            self.err.write(f"warning: {', '.join(missing)} not provided; snapshot stamped 'unknown'\n")
        self.out.write(text)
        return self._upload(options, lambda: text)


def main() -> int:
    def spark() -> SparkSession:
        session = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        session.sparkContext.setLogLevel("ERROR")
        return session

    return Cli(spark, sys.stdout, sys.stderr, colours(redirected=not sys.stdout.isatty())).run(sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
