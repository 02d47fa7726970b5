import io
import itertools
import json

import pytest

from tessera.operators import crap
from tessera.plans import cli, report
from tessera.sinks import documents, render
from tessera.sinks.text import Pen, colours, pct, signed, tenth
from tessera.sources import xml
from tests.builder import cls, document, line, method, metrics


@pytest.fixture
def load(spark, tmp_path):
    def run(*texts):
        paths = []
        for i, t in enumerate(texts):
            p = tmp_path / f"r{i}.xml"
            p.write_text(t)
            paths.append(str(p))
        return report.load(spark, paths)

    return run


def rows(r):
    return {f.path: f for f in r.file_rows()}


def test_line_rules(load):
    doc = document(
        cls(
            "A.cs",
            [
                line(1, 3), line(2, 0), line(3), line(4, "x"), line(5, 3_000_000_000), line("x", 1), line(" 6 ", "+2"),
                line(7, 1, "50% (1/2)", branch="True"), line(8, 1, "bad"), line(9, -1), line(10, 1, "0% (0/0)"),
            ],
        ),
        cls("A.cs", [line(1, 1), line(2, 5), line(7, 0, "100% (2/2)")]),
        cls("Empty.cs"),
        cls(None, [line(1, 1)]),
        head="<?xml version='1.0'?><!DOCTYPE coverage SYSTEM 'x.dtd'>",
    )
    r = load(doc)
    a = rows(r)["A.cs"]
    assert (a.lines_total, a.lines_hit) == (10, 7)
    assert a.uncovered == [3, 4, 9]
    assert (a.branches_hit, a.branches_total) == (2, 2)
    assert (a.strict, a.partial) == (8, 0)  # the negative line counts as strictly hit
    assert rows(r)["Empty.cs"].line_rate is None
    assert [w.kind for w in r.warning_rows] == ["MalformedHits", "MalformedConditionCoverage"]
    hits = {x.line: x.hits for x in r.lines.collect()}
    assert hits[5] == 2**31 - 1 and hits[1] == 3 and hits[6] == 2


def test_conditions(load):
    whole = document(cls("A.cs", [line(1, 1, "50% (2/4)", [(0, "100%"), (1, "0%")])]), cls("A.cs", [line(1, 1, "50% (2/4)", [(0, "0%"), (1, "100%")])]))
    assert rows(load(whole))["A.cs"].branches_hit == 4
    plain = document(cls("A.cs", [line(1, 1, "50% (2/4)")]))
    assert rows(load(whole, plain))["A.cs"].branches_hit == rows(load(plain, whole))["A.cs"].branches_hit == 4
    counts = document(cls("A.cs", [line(1, 1, "50% (1/2)", [(0, "1"), (1, "1")])]))  # detail that doesn't account for the branches
    assert rows(load(counts))["A.cs"].branches_hit == 1


def test_poisoning_in_any_order(load):
    a = document(cls("A.cs", [line(5, 1, "25% (1/4)", [(1, "0%"), (2, "50%")])]))
    b = document(cls("A.cs", [line(5, 1, "25% (1/4)", [(1, "50%"), (2, "0%")])]))
    c = document(cls("A.cs", [line(5, 1, "25% (1/4)", [(0, "0%"), (3, "50%")])]))
    for order in itertools.permutations((a, b, c)):
        r = load(*order)
        f = rows(r)["A.cs"]
        assert (f.branches_hit, f.branches_total) == (1, 4)
        assert [(w.kind, w.line) for w in r.warning_rows] == [("ConditionIdentityMismatch", 5)]


def test_total_never_shrinks(load):
    r = load(document(cls("A.cs", [line(1, 1, "50% (1/2)", [(0, "50%")])])), document(cls("A.cs", [line(1, 1, "25% (1/4)")])))
    assert rows(r)["A.cs"].branches_total == 4
    assert [(w.kind, w.detail) for w in r.warning_rows] == [("BranchTotalMismatch", "Total 2 vs 4 — keeping 4")]


def test_roots(load):
    r = load(document(cls("a\\B.cs", [line(1, 1)]), cls("/abs.cs", [line(1, 1)]), cls("d:\\x.cs", [line(1, 1)]), roots=["c:\\repo\\", "c:/repo"]))
    assert sorted(rows(r)) == ["/abs.cs", "C:/repo/a/B.cs", "D:/x.cs"]
    assert not r.warning_rows
    two = load(document(cls("B.cs", [line(1, 1)]), roots=[".", "/r"]))
    assert list(rows(two)) == ["B.cs"] and two.warning_rows[0].kind == "FileIdentityAmbiguous"
    both = load(document(cls("src/P.cs", [line(1, 1)]), roots=["/a"]), document(cls("src/P.cs", [line(1, 0)]), roots=["/b"]))
    assert sorted(rows(both)) == ["/a/src/P.cs", "/b/src/P.cs"]
    assert [(w.kind, w.file) for w in both.warning_rows] == [("FileIdentityAmbiguous", "/a/src/P.cs")]
    assert both.roots == ("/a", "/b")


@pytest.mark.parametrize("text", ["", "hello", "<coverage><packages>", "<a></b>", "<coverage/>junk", "<!DOCTYPE c [<!ENTITY x SYSTEM 'file:///etc/passwd'>]><coverage>&x;</coverage>"])
def test_malformed(load, text):
    with pytest.raises(xml.XmlError, match=r"r0\.xml"):
        load(text)


def test_limits():
    assert xml.problem(b"<a>" + b"x" * 100 + b"</a>", 50)
    assert xml.problem(b"<a>" + b"x" * 100 + b"</a>", 0) is None
    laughs = b"<!DOCTYPE a [<!ENTITY l '" + b"l" * 200 + b"'>]><a>" + b"&l;" * 6 + b"</a>"
    assert xml.problem(laughs)


def test_find_reports(tmp_path):
    (tmp_path / "b").mkdir()
    for p in ("x.xml", "b/x.xml", "b/y.xml", "_x.xml"):
        (tmp_path / p).write_text("<coverage/>")
    assert [p.removeprefix(str(tmp_path)) for p in xml.find_reports(str(tmp_path), "**/x.xml")] == ["/b/x.xml", "/x.xml"]
    assert len(xml.find_reports(str(tmp_path), "x.xml")) == 1
    for bad in ("", "**/", "a/b.xml", "a\\b", "*/x.xml"):
        with pytest.raises(ValueError, match="pattern"):
            xml.find_reports(str(tmp_path), bad)


@pytest.mark.parametrize(
    ("hit", "total", "least", "want"),
    [(29, 50, 58, "Pass"), (29, 100, 29, "Pass"), (803, 1000, 80.3, "Pass"), (57, 100, 58, "Fail"), (5799, 10000, 58, "Fail"), (1, 100, 0, "Disabled")],
)
def test_gate(spark, hit, total, least, want):
    from tessera.operators import rollup

    row = spark.createDataFrame([(hit, total, 0, 0, hit, 0)], "lines_hit long, lines_total long, branches_hit long, branches_total long, strict long, partial long")
    gate = rollup.evaluate(rollup.report_rollup(rollup.with_rates(row)), least)
    assert gate.outcome == want
    assert rollup.evaluate(rollup.report_rollup(rollup.with_rates(row)), 50, 75).outcome == "NoData"


def test_gate_text(load):
    r = load(document(cls("A.cs", [line(i, int(i > 1)) for i in range(1, 6)])))
    assert render.gate_line(r.evaluate(80)) == "PASS: line 80.0% (min 80%), branch n/a (min 0%) - thresholds met"
    assert render.gate_line(r.evaluate(80.3, 50)).startswith("NODATA: line 80.0% (min 80.3%), branch n/a (min 50%) - branch threshold of 50% requested")
    empty = load(document())
    assert empty.evaluate(80).outcome == "NoData" and "no data" in render.gate_markdown(empty, empty.evaluate(80))


def test_exclude(load):
    r = load(document(cls("src/A.cs", [line(1, 1)]), cls("obj/B.cs", [line(1, 0)]), cls("Program.cs", [line(1, 0)]), cls("src/X.G.CS", [line(1, 0)])))
    from tessera.functions.paths import WELL_KNOWN

    assert sorted(rows(r.exclude(WELL_KNOWN))) == ["src/A.cs"]
    assert sorted(rows(r.exclude(WELL_KNOWN, ["program.cs"]))) == ["Program.cs", "src/A.cs"]
    assert r.exclude([]) is r


def test_diff(load):
    before = load(document(cls("src/app/A.cs", [line(1, 1), line(2, 0), line(3, 5)]), cls("Gone.cs", [line(1, 1)]), cls("Same.cs", [line(1, 100)]), cls("None.cs")))
    after = load(document(cls("/_/src/app/A.cs", [line(1, 0), line(2, 7), line(4, 1)]), cls("New.cs", [line(1, 0)]), cls("Same.cs", [line(1, 1)]), cls("None.cs")))
    d = report.compare(before, after)
    assert {f.path: f.change for f in d.files} == {"/_/src/app/A.cs": "Unchanged", "Gone.cs": "Removed", "New.cs": "Added", "Same.cs": "Unchanged", "None.cs": "Unchanged"}
    assert [(c.line, c.change) for c in d.lines["/_/src/app/A.cs"]] == [(1, "NewlyMissed"), (2, "NewlyHit"), (3, "Removed"), (4, "Added")]
    assert list(d.lines) == ["/_/src/app/A.cs"]
    assert d.files[0].path == "None.cs" and d.files[1].path == "Gone.cs"
    assert "1 newly missed, 1 newly hit, 1 added, 1 removed" in render.diff_markdown(d)
    assert "Indirect changes: 4 lines flipped across 1 file" in render.diff_table(d)
    assert json.loads(documents.diff_json(d))["summary"]["indirectLineChanges"] == 4


def test_no_pair_without_evidence(load):
    d = report.compare(load(document(cls("svc-a/P.cs", [line(1, 1)]))), load(document(cls("svc-b/P.cs", [line(1, 1)]))))
    assert sorted(f.change for f in d.files) == ["Added", "Removed"]
    d = report.compare(load(document(cls("SRC/App.cs", [line(1, 1)]))), load(document(cls("src/App.cs", [line(1, 1)]))))
    assert [f.change for f in d.files] == ["Unchanged"]


def risk_of(spark, tmp_path, *classes, members=None, most=6):
    p = tmp_path / "m.xml"
    p.write_text(document(*classes))
    lines, headers = report.parse_methods(spark, str(p))
    found = None
    if members:
        q = tmp_path / "metrics.xml"
        q.write_text(members)
        found = report.parse_metrics(spark, str(q))
    return report.risk(crap.analyze(lines, headers, found), most)


def test_crap_folding(spark, tmp_path):
    r = risk_of(
        spark, tmp_path,
        cls("C.cs", name="A.C", methods=[method("Use", [line(5, 1)], complexity=1), method("Frob", [line(9, 0)], "(Int32)", 20), method("Frob", [line(11, 1)], "(String)", 1), method("None", complexity=3)]),
        cls("C.cs", name="A.C/&lt;&gt;c__DisplayClass0_0", methods=[method("&lt;Use&gt;b__0", [line(6, 0)], complexity=2), method(".ctor", [line(1, 0)], complexity=9)]),
        cls("C.cs", name="A.C/&lt;Frob&gt;d__2", methods=[method("MoveNext", [line(20, 0)], complexity=5)]),
    )
    got = sorted((m.method, m.complexity, m.coverage, m.score) for m in r.methods)
    assert got == [("A.C.Frob", 1, 1.0, 1.0), ("A.C.Frob", 5, 0.0, 30.0), ("A.C.Frob", 20, 0.0, 420.0), ("A.C.Use", 2, 0.5, 2.5)]
    assert (r.outcome, r.above) == ("Fail", 2) and r.unscored[0].method == "A.C.None"
    assert render.risk_line(r) == "FAIL: worst CRAP 420.0 (max 6) - 2 of 4 methods above threshold"
    assert "... 3 more methods below (--top 1)" in render.risk_table(r, 1)
    assert json.loads(documents.risk_json(r, 1))["methods"][0]["crap"] == 420


def test_crap_metrics(spark, tmp_path):
    members = metrics("A", {"C": [("Method", "int C.Run(int a)", 4), ("Method", "int C.Run(int a, int b)", 9), ("Method", "void C.Lost()", 2), ("Property", "int C.P", 3), ("Field", "int C.f", None), ("Property", "int C.Q", 5, [("int C.Q.get", 1)])]})
    r = risk_of(
        spark, tmp_path,
        cls("C.cs", name="A.C", methods=[method("Run", [line(1, 1)], "(Int32)"), method("get_P", [line(2, 1)]), method("get_Q", [line(3, 1)]), method("Other", [line(4, 1)]), method("Odd", [line(5, 1)], complexity="NaN")]),
        members=members,
    )
    assert {m.method: m.complexity for m in r.methods} == {"A.C.Run": 4, "A.C.get_P": 3, "A.C.get_Q": 1}
    assert {u.method for u in r.unscored} == {"A.C.Other", "A.C.Odd"}
    assert r.unmatched == ["int C.Run(int a, int b)", "void C.Lost()"]


def test_json_and_table(load):
    r = load(document(cls("A.cs", [line(1, 1, "50% (1/2)"), line(2, 0), line(3, 1)]), cls("B.cs")))
    body = json.loads(documents.report_json(r))
    assert body["summary"] == {"lineRate": 66.67, "branchRate": 50, "hasBranchData": True, "totalLines": 3, "coveredLines": 2, "totalBranches": 2, "coveredBranches": 1}
    assert body["files"][0]["partialBranches"] == [{"line": 1, "covered": 1, "total": 2}] and "lineRate" not in body["files"][1] and "warnings" not in body
    table = render.report_table(r).splitlines()
    assert table[2].startswith("B.cs") and table[3].split() == ["A.cs", "2/3", "66.7%", "1/2", "50.0%"] and table[-1].split()[0] == "TOTAL"
    assert json.loads(documents.snapshot_json(r, "c", "b", "p", "h"))["fileHash"] == "h"


def test_numbers():
    assert tenth(62.05) == "62.0" and tenth(0.25) == "0.3" and tenth(-0.0) == "0.0"
    assert pct(0.7996, True) == "79.9%" and pct(None) == "-" and signed(0.1) == "+10.0%"
    assert Pen(True).rate("x", 0.8) == "\x1b[32mx\x1b[39m" and Pen(True).rate("x", None) == "\x1b[2mx\x1b[22m" and Pen().bold("x") == "x"
    assert not colours({"NO_COLOR": "1", "FORCE_COLOR": "1"}) and colours({"FORCE_COLOR": "1"}) and not colours({"FORCE_COLOR": "0"}) and colours({"TF_BUILD": "x"}) and not colours({"TERM": "dumb", "TF_BUILD": "x"})


def test_cli(spark, tmp_path, monkeypatch):
    p = tmp_path / "coverage.cobertura.xml"
    p.write_text(document(cls("A.cs", [line(1, 1), line(2, 0)], [method("M", [line(1, 1)], complexity=1)])))
    monkeypatch.setenv("GITHUB_STEP_SUMMARY", str(tmp_path / "summary.md"))

    def run(*args):
        out, err = io.StringIO(), io.StringIO()
        return cli.Cli(lambda: spark, out, err).run(list(args)), out.getvalue(), err.getvalue()

    assert run("check", str(tmp_path), "--min-line", "50", "--github-summary")[0] == 0
    assert "✅" in (tmp_path / "summary.md").read_text()
    code, _, err = run("check", str(p), "--min-line", "60")
    assert code == 1 and err == "FAIL: line 50.0% (min 60%), branch n/a (min 0%) - line coverage below threshold\nfiles below line threshold:\n  A.cs: 50.0%\n"
    assert run("report", str(p), "--format", "json")[0] == 0
    assert run("report", str(p), "--format", "xml")[2].startswith("Invalid --format")
    assert run("check", str(p), "--min-line", "nan")[0] == 1
    assert run("crap", str(p), "--top", "1")[0] == 0 and run("crap", str(p), "--top", "0")[0] == 1
    assert run("diff", str(p), str(p))[0] == 0 and run("diff", str(p))[0] == 1
    code, out, err = run("snapshot", str(p), "--commit", "abc")
    assert code == 0 and json.loads(out)["commit"] == "abc" and err == "warning: --branch, --project not provided; snapshot stamped 'unknown'\n"
    assert run("report", str(tmp_path / "no"))[2].startswith("error: No file or directory")
    assert run("report", str(tmp_path), "--pattern", "a/b")[0] == 1
    assert run("report", str(p), "--upload", "ftp://x")[0] == 1
    assert run("nope")[0] == 2 and run()[0] == 0 and run("version")[0] == 0
    assert cli.parse_args(["report", "--exclude-generated", "x.xml", "--keep"]) == ("report", {"exclude-generated": "true", "file": "x.xml", "keep": "true"})


def test_stream(spark, tmp_path):
    from tessera.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text(document(cls("A.cs", [line(1, 0), line(2, 3)])))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"))
    ingest.merge_stream(*args).awaitTermination()
    (tmp_path / "in/b.xml").write_text(document(cls("A.cs", [line(1, 4)])))
    ingest.merge_stream(*args).awaitTermination()
    assert {r.line: r.hits for r in spark.read.parquet(str(tmp_path / "t/v=1")).collect()} == {1: 4, 2: 3}


def test_build_step(spark, tmp_path, monkeypatch):
    from tessera.plans import build

    monkeypatch.setenv("GITHUB_STEP_SUMMARY", str(tmp_path / "no/summary.md"))
    told = []
    with pytest.raises(build.BuildFailed, match="No files matching"):
        build.report_coverage(spark, build.Config(folder=str(tmp_path / "none")))
    (tmp_path / "coverage.cobertura.xml").write_text(document(cls("A.cs", [line(1, 1), line(2, 0)])))
    build.report_coverage(spark, build.Config(folder=str(tmp_path), min_line="50", format="md"), told.append)
    assert "✅" in told[0] and told[1].startswith("warning")
    with pytest.raises(build.BuildFailed, match="FAIL: line 50.0%"):
        build.report_coverage(spark, build.Config(folder=str(tmp_path)), told.append)
    for bad in ({"min_line": "nan"}, {"exclude_generated": "yes"}, {"max_chars": "-1"}, {"format": "xml"}):
        with pytest.raises(ValueError, match="Invalid"):
            build.report_coverage(spark, build.Config(folder=str(tmp_path), **bad), told.append)


def test_parse_text(spark):
    with report.cancellable(spark, "parse") as cancel:
        r = report.parse(spark, document(cls("A.cs", [line(1, 1)])), document(cls("A.cs", [line(2, 0)])))
        assert (r.total.lines_hit, r.total.lines_total) == (1, 2) and callable(cancel)
    with pytest.raises(xml.XmlError):
        report.parse(spark, "<a>")


def test_every_name_is_read(spark, tmp_path):
    names = ["_a.xml", ".a.xml", "x[1].xml", "a b.xml", "a%20b.xml", "c:d.xml", "q?*{x}.xml", "é\\b.xml"]
    for i, name in enumerate(names):
        (tmp_path / name).write_text(document(cls(f"{i}.cs", [line(1, 1)])))
    found = report.load(spark, [str(tmp_path / n) for n in names])
    assert sorted(rows(found)) == [f"{i}.cs" for i in range(len(names))]
    # hidden files are passed over in folders, as folders list them
    assert sorted(xml.find_reports(str(tmp_path), "*.xml")) == sorted(str(tmp_path / n) for n in names if not n.startswith("."))
    assert list(rows(report.parse_path(spark, f"file:{tmp_path}/_a.xml"))) == ["0.cs"]


def test_missing_files_are_named(spark, tmp_path):
    (tmp_path / "a.xml").write_text(document())
    with pytest.raises(xml.XmlError, match=r"gone\.xml: The file can't be read"):
        report.load(spark, [str(tmp_path / "a.xml"), str(tmp_path / "gone.xml")])
    with pytest.raises(FileNotFoundError):
        report.parse_path(spark, str(tmp_path / "none"))


def test_other_file_systems(spark, tmp_path):
    """Paths of another scheme are listed and read through Spark; what its reader passes over is named."""
    conf = spark._jsc.hadoopConfiguration()
    (tmp_path / "b").mkdir()
    for name, file in (("x[1].xml", "A.cs"), ("b/y.xml", "B.cs"), (".z.xml", "C.cs")):
        (tmp_path / name).write_text(document(cls(file, [line(1, 1)])))
    conf.set("fs.viewfs.mounttable.m.link./d", f"file://{tmp_path}")
    assert sorted(rows(report.parse_path(spark, "viewfs://m/d", "**/*.xml"))) == ["A.cs", "B.cs"]
    assert list(rows(report.parse_path(spark, "viewfs://m/d/b/y.xml"))) == ["B.cs"]
    with pytest.raises(FileNotFoundError):
        report.parse_path(spark, "viewfs://m/d/none")
    (tmp_path / "_u.xml").write_text(document())
    with pytest.raises(xml.XmlError, match=r"_u\.xml: The file can't be read"):
        report.parse_path(spark, "viewfs://m/d", "**/*.xml")


def test_encodings(spark, tmp_path):
    codes = ("utf-16", "iso-8859-1", "utf-8-sig")
    for code in codes:
        head = f'<?xml version="1.0" encoding="{code.removesuffix("-sig")}"?>'
        (tmp_path / code).write_bytes(document(cls(f"é{code}.cs", [line(1, 1)]), head=head).encode(code))
    assert sorted(rows(report.load(spark, [str(tmp_path / c) for c in codes]))) == sorted(f"é{c}.cs" for c in codes)


# documents of known producers, in miniature


def test_elements_wherever_they_stand(load):
    """Classes and roots outside the usual nesting, prefixed names, lines of classes without a file."""
    doc = (
        '<c:coverage xmlns:c="u"><x><c:source>/r</c:source></x><package><c:class filename="A.cs" name="A"><any><c:line number="1" hits="2"/></any></c:class></package>'
        '<class name="none"><lines><line number="1" hits="0"/></lines><class filename="In.cs"><line number="3" hits="1"/></class></class>'
        '<sources><source><!-- late -->/no</source><source>/late</source></sources><class filename="B.cs"><line number="1" hits="1"/></class></c:coverage>'
    )
    r = load(doc)
    assert sorted(rows(r)) == ["/r/A.cs", "/r/B.cs", "/r/In.cs"] and r.roots == ("/r", "/late")
    assert load("<coverage><class filename='A.cs'/><source>/r</source><class filename='A.cs'/></coverage>").files.count() == 2


def test_gcovr(load):
    """Lines under class only, one root, branches with conditions of one jump each."""
    lines = [line(3, 12), line(4, 0), line(7, 5, "50% (1/2)", [(0, "50%")]), line(9, 5, "100% (2/2)", [(0, "100%")])]
    f = rows(load(document(cls("src/main.cpp", lines, name="main_cpp"), roots=["/home/u/p"])))["/home/u/p/src/main.cpp"]
    assert (f.lines_hit, f.lines_total, f.branches_hit, f.branches_total, f.strict, f.partial) == (3, 4, 3, 4, 2, 1)


def test_coverage_py(load):
    """Empty methods, missing-branches attributes, counts without condition detail."""
    doc = document(cls("pkg/a.py", [line(1, 1), line(2, 1, "50% (1/2)"), line(5, 0, "0% (0/2)")], name="a.py"), roots=["/src"]).replace('condition-coverage="50%', 'missing-branches="5" condition-coverage="50%')
    f = rows(load(doc))["/src/pkg/a.py"]
    assert (f.lines_hit, f.lines_total, f.branches_hit, f.branches_total, f.strict) == (2, 3, 1, 4, 1)


def test_cover2cover(load):
    """Several roots, inner classes of one file, methods with lines of their own that the class repeats."""
    inner = cls("org/A.java", [line(9, 0)], [method("run", [line(9, 0)], "()V")], name="org.A$1")
    outer = cls("org/A.java", [line(3, 1), line(4, 1, "75% (3/4)")], [method("&lt;init&gt;", [line(3, 1)], "()V"), method("go", [line(4, 1)], "()V")], name="org.A")
    r = load(document(outer, inner, roots=["src/main/java", "src/test/java"]))
    f = rows(r)["src/main/java/org/A.java"]
    assert (f.lines_hit, f.lines_total, f.branches_hit, f.branches_total) == (2, 3, 3, 4)
    assert [w.kind for w in r.warning_rows] == ["FileIdentityAmbiguous"]


def test_grcov(load):
    """A root that means the current folder, and lines in methods and again in the class."""
    f = rows(load(document(cls("lib.rs", [line(1, 2), line(2, 0)], [method("main", [line(1, 2)]), method("off", [line(2, 0)])]), roots=["."])))["lib.rs"]
    assert (f.lines_hit, f.lines_total) == (1, 2)


def test_report_generator(load):
    """Merged output: a root that stands twice, paths with either separator, one class a part of a file."""
    r = load(document(cls("a\\B.cs", [line(1, 0)]), cls("a/B.cs", [line(1, 3), line(2, 1, "100% (2/2)")]), roots=["/repo/", "/repo"]))
    assert list(rows(r)) == ["/repo/a/B.cs"] and rows(r)["/repo/a/B.cs"].lines_hit == 2 and not r.warning_rows


def test_nested_types(spark, tmp_path):
    """Types in types, generics at any depth, members in the order they end."""
    deep = "G&lt;" * 12 + "T" + "&gt;" * 12
    body = (
        f'<NamedType Name="Outer&lt;A&gt;"><Members><Property Name="int Outer.P"><Metrics><Metric Name="CyclomaticComplexity" Value="1"/></Metrics><Accessors><Method Name="int Outer.P.get"><Metrics><Metric Name="CyclomaticComplexity" Value=" +2 "/></Metrics></Method></Accessors></Property>'
        f'</Members><Types><NamedType Name="{deep}"><Members><Method Name="void G.M(int a)"><Metrics><Metric Name="CyclomaticComplexity" Value="7"/></Metrics></Method><Method Name="void G.Bad()"><Metrics><Metric Name="CyclomaticComplexity" Value="x"/></Metrics></Method></Members></NamedType></Types></NamedType>'
    )
    (tmp_path / "m.xml").write_text(f'<CodeMetricsReport><Namespace Name="N"><Types>{body}</Types></Namespace></CodeMetricsReport>')
    got = [(m.pos, m.type_name, m.member_name, m.kind, m.complexity) for m in report.parse_metrics(spark, str(tmp_path / "m.xml")).orderBy("pos").collect()]
    assert got == [(0, "N.Outer", "get_P", "Accessor", 2), (1, "N.Outer", "P", "Property", 1), (2, "N.Outer.G", "M", "Method", 7)]


def test_cancel(spark):
    """A scan in a group of its own stops when another thread cancels it."""
    import threading
    import time

    from pyspark.sql import functions as F

    with report.cancellable(spark, "slow") as cancel:
        threading.Thread(target=lambda: (time.sleep(3), cancel()), daemon=True).start()
        slow = spark.range(4, numPartitions=4).withColumn("x", F.pandas_udf(lambda s: (time.sleep(40), s)[1], "long")("id"))
        began = time.monotonic()
        with pytest.raises(Exception, match="(?i)cancel"):
            slow.agg(F.sum("x")).collect()
        assert time.monotonic() - began < 30
    assert report.parse(spark, document(cls("A.cs", [line(1, 1)]))).found == 1


def test_switch():
    from tessera.functions.rates import switch_change

    seen = []
    kinds = {"Added": "added", "Removed": "removed", "NewlyHit": "newly_hit", "NewlyMissed": "newly_missed"}
    for kind, name in kinds.items():
        switch_change(kind, **{n: (lambda n=n: seen.append(n)) for n in kinds.values()})
        assert seen[-1] == name
    with pytest.raises(TypeError):
        switch_change("Added", added=list)


def test_ingest_rejects_and_recovers(spark, tmp_path):
    """Malformed documents are told, condition detail stays, a lost checkpoint changes nothing, old versions go."""
    import shutil

    from tessera.streaming import ingest

    (tmp_path / "in").mkdir()
    a = document(cls("A.cs", [line(1, 1, "50% (2/4)", [(0, "100%"), (1, "0%")])]))
    b = document(cls("A.cs", [line(1, 1, "50% (2/4)", [(0, "0%"), (1, "100%")]), line(2, 0)]))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"))
    for name, text in (("a", a), ("bad", "<coverage><x>"), ("b", b)):
        (tmp_path / f"in/{name}.xml").write_text(text)
        ingest.merge_stream(*args).awaitTermination()
    state = lambda: sorted((r.line, r.hits, r.cov, r.tot) for r in ingest.read_table(spark, args[2]).collect())
    assert state() == [(1, 1, 4, 4), (2, 0, None, None)]
    bad = spark.read.parquet(f"{args[2]}/rejected/*").collect()
    assert len(bad) == 1 and bad[0].path.endswith("bad.xml") and bad[0].problem
    shutil.rmtree(args[3])
    ingest.merge_stream(*args).awaitTermination()
    assert state() == [(1, 1, 4, 4), (2, 0, None, None)] and len(ingest.versions(spark, args[2])) <= ingest.KEPT
