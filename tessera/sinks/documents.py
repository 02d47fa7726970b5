"""JSON documents, and where text and documents go: uploads, step summaries, file hashes."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Row

from tessera.functions.rates import RATE_EPSILON
from tessera.plans.report import Difference, Report, Risk

TIMEOUT_S = 30


def _number(x: float | None) -> float | int | None:
    """Two digits, halves to even; whole values without a point."""
    if x is None:
        return None
    y = round(x * 100) / 100
    return int(y) if y == int(y) else y


def _percent(rate: float | None) -> float | int | None:
    return None if rate is None else _number(rate * 100)


def _held(**fields: object) -> dict:
    """Fields that have a value: a missing key says not measured, or nothing to tell."""
    return {k: v for k, v in fields.items() if v is not None and v != []}


def _dump(document: dict) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False)


def _summary(t: Row) -> dict:
    return _held(
        lineRate=_percent(t.line_rate), branchRate=_percent(t.branch_rate), hasBranchData=t.branches_total > 0, totalLines=t.lines_total,
        coveredLines=t.lines_hit, totalBranches=t.branches_total, coveredBranches=t.branches_hit,
    )


def _file(f: Row) -> dict:
    return _held(
        path=f.path, lineRate=_percent(f.line_rate), branchRate=_percent(f.branch_rate), linesHit=f.lines_hit, linesTotal=f.lines_total, branchesHit=f.branches_hit,
        branchesTotal=f.branches_total, uncoveredLines=list(f.uncovered or ()), partialBranches=[{"line": b.line, "covered": b.covered, "total": b.total} for b in f.partial_branches or ()],
    )


def _body(report: Report) -> dict:
    warnings = [{"kind": w.kind, "file": w.file, "line": w.line, "detail": w.detail} for w in report.warning_rows]
    return {"summary": _summary(report.total), "files": [_file(f) for f in report.file_rows()]} | ({"warnings": warnings} if warnings else {})


def report_json(report: Report) -> str:
    return _dump(_body(report))


def snapshot_json(report: Report, commit: str, branch: str, project: str, file_hash: str | None = None, now: datetime | None = None) -> str:
    """The report under the identity of a build; the time keeps its offset."""
    stamp = (now or datetime.now(UTC)).isoformat()
    return _dump(_held(commit=commit, branch=branch, project=project, timestamp=stamp, fileHash=file_hash) | _body(report))


def diff_json(diff: Difference) -> str:
    files = []
    for f in diff.files:
        lines = [_held(line=c.line, beforeHits=c.before_hits, afterHits=c.after_hits, change=c.change.lower()) for c in diff.lines.get(f.path, ())]
        files.append(_held(path=f.path, before=_percent(f.before), after=_percent(f.after), delta=_percent(f.delta), change=f.change.lower(), lineChanges=lines))
    summary = _held(before=_percent(diff.before), after=_percent(diff.after), delta=_percent(diff.delta), indirectLineChanges=diff.line_count)
    return _dump({"summary": summary, "files": files})


def risk_json(risk: Risk, top: int | None = None) -> str:
    above = lambda m: m.score > risk.most + RATE_EPSILON
    gate = _held(
        outcome=risk.outcome.lower(), maxCrap=int(risk.most) if risk.most == int(risk.most) else risk.most, scoredMethods=risk.scored,
        aboveThreshold=risk.above, worstScore=_number(risk.methods[0].score) if risk.methods else None, reason=risk.reason,
    )
    methods = [
        {"method": m.method, "file": m.file, "line": m.start_line, "complexity": m.complexity, "coverage": _percent(m.coverage), "crap": _number(m.score), "aboveThreshold": above(m), "complexitySource": m.source}
        for m in risk.methods[:top]
    ]
    more = _held(unscored=[{"method": u.method, "file": u.file, "reason": u.reason} for u in risk.unscored], unmatchedMetricsMembers=risk.unmatched)
    return _dump({"gate": gate, "methods": methods} | more)


def file_hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def upload(url: str, document: Callable[[], str]) -> tuple[bool, str]:
    """Posts the document, made only now; whether it went well, and what to tell."""
    try:
        request = urllib.request.Request(url, document().encode(), {"Content-Type": "application/json; charset=utf-8"})
        if not url.lower().startswith(("http://", "https://")):
            raise ValueError("only http and https can be posted to")
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
            return True, f"Uploaded to {url} ({answer.reason})"
    except urllib.error.HTTPError as e:
        return False, f"Upload failed: {url} ({e.reason})"
    except (OSError, ValueError) as e:
        return False, f"Upload failed: {url} ({e})"


def append_summary(path: str | None, markdown: str) -> str | None:
    """Appends to the step summary, if there is one; a warning if that fails."""
    if not path:
        return None
    try:
        with open(path, "a", encoding="utf-8") as f:
            f.write(markdown)
    except (OSError, ValueError) as e:
        return f"warning: could not write GITHUB_STEP_SUMMARY: {e}"
    return None
