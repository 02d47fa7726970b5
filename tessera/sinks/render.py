"""Reports, differences and risks as text tables and markdown pages.

Headings, column widths and table rules are fixed values of the output formats.
"""

from __future__ import annotations

from collections.abc import Sequence

from tessera.functions.rates import RATE_EPSILON
from tessera.operators.rollup import Gate
from tessera.plans.report import Difference, Report, Risk
from tessera.sinks.text import Pen, pct, plural, short, signed, tenth

_BADGE = {"Pass": " ✅", "Fail": " ❌", "NoData": " ⚠️", "Disabled": " ⚠️"}
#: Kinds of line changes in the order they are told.
_TOLD = (("newly_missed", "newly missed"), ("newly_hit", "newly hit"), ("added", "added"), ("removed", "removed"))


def _lines(rows: Sequence[str]) -> str:
    return "".join(f"{r}\n" for r in rows)


def gate_line(gate: Gate) -> str:
    rate = lambda r, low: "n/a" if r is None else pct(r, low)
    return (
        f"{gate.outcome.upper()}: line {rate(gate.line_rate, gate.line_below)} (min {short(gate.min_line)}%), "
        f"branch {rate(gate.branch_rate, gate.branch_below)} (min {short(gate.min_branch)}%) - {gate.reason}"
    )


def risk_line(risk: Risk) -> str:
    worst = tenth(risk.methods[0].score) if risk.methods else "n/a"
    return f"{risk.outcome.upper()}: worst CRAP {worst} (max {short(risk.most)}) - {risk.reason}"


def _cells(hit: int, total: int, rate: float | None, shown: bool = True) -> tuple[str, str]:
    return f"{f'{hit}/{total}' if shown else '-':>10}", f"{pct(rate):>8}"


def report_table(report: Report, colour: bool = False) -> str:
    pen, files, total = Pen(colour), report.worst_first(), report.total
    width = max([4, *(len(f.path) for f in files)])
    head = f"{'File':<{width}}  {'Lines':>10}  {'Line %':>8}  {'Branches':>10}  {'Branch %':>8}"
    rule = pen.dim("-" * len(head))
    plain = lambda s: s

    def row(name: str, r, style=plain) -> str:
        line, line_pct = _cells(r.lines_hit, r.lines_total, r.line_rate)
        branch, branch_pct = _cells(r.branches_hit, r.branches_total, r.branch_rate, r.branches_total > 0)
        cells = [pen.rate(line, r.line_rate), pen.rate(line_pct, r.line_rate), pen.rate(branch, r.branch_rate), pen.rate(branch_pct, r.branch_rate)]
        return "  ".join([style(f"{name:<{width}}"), *map(style, cells)])

    rows = [pen.bold(pen.cyan(head)), rule, *(row(f.path, f) for f in files), rule, row("TOTAL", total, pen.bold)]
    if report.warning_rows:
        rows.append(pen.dim(f"Warnings: {len(report.warning_rows)}"))
    return _lines(rows)


def diff_table(diff: Difference, colour: bool = False) -> str:
    pen = Pen(colour)
    width = max([4, *(len(f.path) for f in diff.files)])
    head = f"{'File':<{width}}  {'Before':>8}  {'After':>8}  {'Delta':>8}  {'Change':>10}"
    rule = pen.dim("-" * len(head))
    paint = {"Added": pen.green, "Removed": pen.red, "Modified": pen.yellow}
    rows = [pen.bold(pen.cyan(head)), rule]
    rows += [
        f"{f.path:<{width}}  {pct(f.before):>8}  {pct(f.after):>8}  {pen.delta(f'{signed(f.delta):>8}', f.delta)}  {paint.get(f.change, pen.dim)(f'{f.change:>10}')}"
        for f in diff.files
    ]
    total = pen.delta(f"{signed(diff.delta):>8}", diff.delta)
    rows += [rule, "  ".join(map(pen.bold, (f"{'TOTAL':<{width}}", f"{pct(diff.before):>8}", f"{pct(diff.after):>8}", total)))]
    if diff.line_count:
        rows.append(pen.dim(f"Indirect changes: {plural(diff.line_count, 'line')} flipped across {plural(len(diff.counts), 'file')}"))
    return _lines(rows)


def report_markdown(report: Report, threshold: float | None = None) -> str:
    """Judged by lines only, rates as they are."""
    gate = None if threshold is None else report.evaluate(threshold)
    return _page(report, gate, None if threshold is None else f"**Threshold:** {tenth(threshold)[:-2] if threshold == int(threshold) else f'{threshold:.0f}'}%", False)


def gate_markdown(report: Report, gate: Gate) -> str:
    """Judged by the gate; what fails is floored, never shown as the threshold it misses."""
    return _page(report, gate, f"**Threshold:** line {short(gate.min_line)}%, branch {short(gate.min_branch)}%", True) + f"\n`{gate_line(gate)}`\n"


def _page(report: Report, gate: Gate | None, threshold: str | None, floor: bool) -> str:
    total = report.total
    low_line, low_branch = floor and gate.line_below, floor and gate.branch_below
    misses = lambda rate, least: rate is not None and rate * 100 < least - RATE_EPSILON
    rows = [f"## Coverage Report{_BADGE[gate.outcome] if gate else ''}", ""]
    if total.line_rate is None:
        rows.append("**Line coverage:** no data - the report contains no measured lines")
    else:
        rows.append(f"**Line coverage:** {pct(total.line_rate, low_line)} ({total.lines_hit}/{total.lines_total})")
    if gate and gate.is_inconclusive:
        rows += ["", f"> **No verdict:** {gate.reason}.", ""]
    if total.branches_total:
        rows.append(f"**Branch coverage:** {pct(total.branch_rate, low_branch)} ({total.branches_hit}/{total.branches_total})")
    else:
        rows.append("**Branch coverage:** _no branch data emitted_")
    rows += [threshold] if threshold else []
    rows += ["", "| File | Lines | Line % | Branches | Branch % |", "|------|------:|-------:|---------:|---------:|"]
    for f in report.worst_first():
        branches = f"{f.branches_hit}/{f.branches_total}" if f.branches_total else "-"
        line = pct(f.line_rate, low_line and misses(f.line_rate, gate.min_line))
        branch = pct(f.branch_rate, low_branch and misses(f.branch_rate, gate.min_branch))
        rows.append(f"| `{f.path}` | {f.lines_hit}/{f.lines_total} | {line} | {branches} | {branch} |")
    if report.warning_rows:
        rows += ["", "### Warnings", "", *(f"- `{w.file}:{w.line}` — {w.kind}: {w.detail}" for w in report.warning_rows)]
    return _lines(rows)


def diff_markdown(diff: Difference) -> str:
    icon = "➡️" if not diff.delta else "📈" if diff.delta > 0 else "📉"
    rows = [f"## Coverage Diff {icon}", "", f"**Overall:** {pct(diff.before)} → {pct(diff.after)} ({signed(diff.delta)})", ""]
    rows += ["| File | Before | After | Delta | Change |", "|------|-------:|------:|------:|--------|"]
    rows += [f"| `{f.path}` | {pct(f.before)} | {pct(f.after)} | {signed(f.delta)} | {f.change} |" for f in diff.files]
    if diff.counts:
        rows += ["", f"### Indirect changes ({plural(diff.line_count, 'line')} across {plural(len(diff.counts), 'file')})", ""]
        for f in diff.files:
            if changes := diff.counts.get(f.path):
                rows.append(f"- `{f.path}`: " + ", ".join(f"{changes[k]} {word}" for k, word in _TOLD if changes[k]))
    return _lines(rows)


def risk_table(risk: Risk, top: int | None = None, colour: bool = False) -> str:
    pen, shown = Pen(colour), risk.methods[:top]
    width = max([6, *(len(m.method) for m in shown)])
    head = f"{'Method':<{width}}  {'Comp':>5}  {'Cov %':>8}  {'CRAP':>8}"
    rule = pen.dim("-" * len(head))
    rows = [pen.bold(pen.cyan(head)), rule]
    for m in shown:
        paint = pen.red if m.score > risk.most + RATE_EPSILON else pen.green
        rows.append(f"{m.method:<{width}}  {m.complexity:>5}  {pct(m.coverage):>8}  {paint(f'{tenth(m.score):>8}')}")
    rows.append(rule)
    if top is not None and risk.scored > top:
        rows.append(pen.dim(f"... {risk.scored - top} more methods below (--top {top})"))
    if risk.unscored:
        rows += [pen.dim(f"Unscored (no complexity source): {len(risk.unscored)}"), *(pen.dim(f"  {u.method} - {u.reason}") for u in risk.unscored)]
    if risk.unmatched:
        rows += [pen.dim(f"Unmatched metrics members: {len(risk.unmatched)}"), *(pen.dim(f"  {name}") for name in risk.unmatched)]
    return _lines(rows)


def risk_markdown(risk: Risk, top: int | None = None) -> str:
    rows = [f"## CRAP Report{_BADGE[risk.outcome]}", "", f"**Threshold:** max CRAP {short(risk.most)} — CRAP(m) = comp² · (1 − cov)³ + comp"]
    if risk.outcome == "NoData":
        rows += ["", f"> **No verdict:** {risk.reason}.", ""]
    shown = risk.methods[:top]
    if shown:
        rows += ["", "| Method | Comp | Cov % | CRAP |", "|--------|-----:|------:|-----:|"]
        rows += [f"| `{m.method}` | {m.complexity} | {pct(m.coverage)} | {tenth(m.score)}{' ❌' if m.score > risk.most + RATE_EPSILON else ''} |" for m in shown]
        if top is not None and risk.scored > top:
            rows += ["", f"_… {risk.scored - top} more methods below (top {top} shown; the gate evaluates all)._"]
    if risk.unscored:
        rows += ["", "### Unscored methods (no complexity source)", "", *(f"- `{u.method}` — {u.reason}" for u in risk.unscored)]
    if risk.unmatched:
        rows += ["", "### Unmatched metrics members", "", *(f"- `{name}`" for name in risk.unmatched)]
    return _lines([*rows, "", f"`{risk_line(risk)}`"])
