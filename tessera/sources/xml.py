"""Coverage and metrics XML as line facts: listing, validating, scanning.

A document is walked once, in the order it stands in, by an event parser inside an Arrow operator: roots hold
for the classes after them, and classes, methods, lines and conditions are found by their names wherever
they stand, which Spark's XML reader, with its fixed nesting, cannot say. The walk gives rows of raw
attributes; all parsing of numbers, paths and percentages is columns. What is malformed is reported by a walk
of its own first: text after the root, no root at all, entities that expand too far.

Scale: a task holds one document, which the cap of characters bounds, and sends its rows in batches.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.functions.paths import below_root, drive_upper, normal_root

PATTERN = "**/coverage.cobertura.xml"
MAX_CHARS = 50_000_000
ENTITY_CHARS = 1024
INT_MIN, INT_MAX = -(2**31), 2**31 - 1

#: Rows of a walk that are sent together.
BATCH_ROWS = 1 << 16
#: What a walk gives: kind is root, class, method or line; pos is the row's place among its kind.
ELEMENTS = (
    "report_ord int, kind string, class_pos int, pos int, root string, filename string, class string, method_pos int, method string, signature string, "
    "complexity string, number string, hits string, branch string, cover string, conds array<struct<number:string,coverage:string>>"
)
MEMBERS = "pos long, type_name string, member_name string, kind string, arity int, complexity int, display string"
_MEMBER_ELEMENTS = ("Method", "Field", "Property", "Event")


class XmlError(ValueError):
    """A document is malformed, too large or unreadable."""


def split_pattern(pattern: str) -> tuple[bool, str]:
    """Whether 'name' or '**/name' looks below the folder, and the name."""
    deep = pattern.startswith("**/")
    name = pattern[3:] if deep else pattern
    if not name or "/" in name or "\\" in name:
        raise ValueError(f"Unsupported pattern '{pattern}': only 'filename' and '**/filename' are supported.")
    return deep, name


def ordinal(paths: Iterable[str]) -> list[str]:
    return sorted(paths, key=lambda p: p.encode("utf-16-be", "surrogatepass"))


def find_reports(folder: str, pattern: str = PATTERN) -> list[str]:
    """Files of a name in the folder ('name'), or below it ('**/name'), sorted; * and ? stand in the name."""
    deep, name = split_pattern(pattern)
    found = []
    for top, dirs, files in os.walk(folder):
        found += [os.path.join(top, f) for f in files if fnmatch.fnmatchcase(f, name) and not f.startswith(".")]
        dirs[:] = [d for d in dirs if not d.startswith(".")] if deep else []
    return ordinal(found)


def is_remote(path: str) -> bool:
    """Does the path name a file system other than the local one."""
    return "://" in path and not path.startswith("file:")


def remote_reports(spark: SparkSession, path: str, pattern: str = PATTERN) -> list[str]:
    """The same for a folder, or a single file, of any file system that Spark's readers know."""
    deep, name = split_pattern(pattern)
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(top):
        raise FileNotFoundError(f"No file or directory at '{path}'.")
    status = store.getFileStatus(top)
    if status.isFile():
        return [status.getPath().toString()]
    base, listing, found = status.getPath().toString(), store.listFiles(top, deep), []
    while listing.hasNext():
        file = listing.next().getPath().toString()
        below = file.removeprefix(base).strip("/").split("/")
        if fnmatch.fnmatchcase(below[-1], name) and not any(p.startswith(".") for p in below):
            found.append(file)
    return ordinal(found)


def problem(data: bytes | None, max_chars: int = MAX_CHARS) -> str | None:
    """What is wrong with a document, with line and column; None: nothing."""
    if not data:
        return "Root element is missing."
    parser, room = expat.ParserCreate(), [ENTITY_CHARS]
    if max_chars and len(data) > max_chars and len(data.decode("utf-8", "replace")) > max_chars:
        return f"The document has more than {max_chars} characters."

    def declared(name: str, is_parameter: bool, value: str | None, *_: object) -> None:
        if not is_parameter and value is not None:
            entities[name] = len(value)

    def external(*_: object) -> int:
        return 0

    entities: dict[str, int] = {}
    parser.EntityDeclHandler = declared
    parser.ExternalEntityRefHandler = external
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        return f"{expat.errors.messages.get(e.code, e)} Line {e.lineno}, position {e.offset + 1}."
    for name, size in entities.items():
        room[0] -= size * data.count(f"&{name};".encode())
    return "Entities expand to more than they may." if room[0] < 0 else None


def read_files(spark: SparkSession, paths: list[str], max_chars: int = MAX_CHARS) -> DataFrame:
    """report_ord (place in paths, from 1), path, xml (bytes). The first file that is malformed or can't be
    read raises XmlError: no path is left out. Local files, whatever their names, are read by the tasks;
    others by Spark's reader, which passes over names that start with _ or . (so these raise)."""
    listing = spark.createDataFrame(list(enumerate(paths, 1)), "report_ord int, path string")
    if not paths:
        return listing.withColumn("xml", F.lit(b"")).limit(0)
    if any(map(is_remote, paths)):
        files = spark.read.format("binaryFile").load([re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]).select(F.col("path").alias("found"), "content")
        rows = listing.join(files, F.col("path") == F.col("found"), "left").withColumn("problem", F.when(F.col("found").isNull(), "The file can't be read."))
        rows = rows.select("report_ord", "path", F.col("content").alias("xml"), "problem")
    else:
        rows = listing.repartition(min(len(paths), 4096), "report_ord").mapInArrow(_read_local(max_chars), "report_ord int, path string, xml binary, problem string")
    bad = rows.mapInArrow(_with_problems(max_chars), "report_ord int, problem string").orderBy("report_ord").limit(1).collect()
    if bad:
        raise XmlError(f"{paths[bad[0].report_ord - 1]}: {bad[0].problem}")
    return rows.select("report_ord", "path", "xml")


def _read_local(max_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, problem = None, None
                try:
                    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
                        # four bytes a character are the most there can be
                        data = f.read(4 * max_chars + 5) if max_chars else f.read()
                except OSError as e:
                    problem = f"The file can't be read: {e.strerror}."
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([path]), pa.array([data], pa.binary()), pa.array([problem], pa.string())], ["report_ord", "path", "xml", "problem"])

    return run


def _with_problems(max_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [known or problem(data, max_chars) for data, known in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            bad = [(n, p) for n, p in zip(batch.column(0).to_pylist(), told, strict=True) if p]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in bad], pa.int32()), pa.array([p for _, p in bad], pa.string())], ["report_ord", "problem"])

    return run


def _events(data: bytes | str, start, end, **other) -> None:
    """Walks a document: start(name, attributes), end(name), with local names, and other handlers of the
    parser. Where a document is malformed the walk ends; problem() tells."""
    parser = expat.ParserCreate("utf-8" if isinstance(data, str) else None)
    parser.buffer_text = True
    parser.StartElementHandler = lambda name, attributes: start(name.rpartition(":")[2], attributes)
    parser.EndElementHandler = lambda name: end(name.rpartition(":")[2])
    parser.ExternalEntityRefHandler = lambda *_: 0
    for name, handler in other.items():
        setattr(parser, name, handler)
    try:
        parser.Parse(data.encode() if isinstance(data, str) else data, True)
    except expat.ExpatError:
        return


def coverage_rows(report: int | None, data: bytes | str) -> list[tuple]:
    """The rows of ELEMENTS of one coverage document."""
    rows: list[tuple] = []
    roots, classes, methods, lines = 0, 0, 0, 0
    first_root: str | None = None
    source: list[str] | None = None  # the text of an open source element that has only text so far
    outer: tuple | None = None  # class_pos, root, filename, name of the class whose lines these are
    inner: tuple | None = None  # method_pos, name, signature of the method the lines are of
    depth, class_depth, method_depth = 0, 0, 0
    conds: list[tuple] | None = None

    def close_source() -> None:
        nonlocal source, roots, first_root
        if source is not None:
            found = "".join(source)
            source = None
            if found.strip():
                rows.append((report, "root", None, roots, found) + (None,) * 11)
                roots += 1
                first_root = found if first_root is None else first_root

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal source, outer, inner, depth, class_depth, method_depth, conds, classes, methods, lines
        depth += 1
        close_source()
        get = attributes.get
        if outer is None:
            if name == "source":
                source = []
            elif name == "class" and "filename" in attributes:
                outer = (classes, first_root, attributes["filename"], get("name") or "")
                rows.append((report, "class", classes, classes, *outer[1:]) + (None,) * 9)
                classes += 1
                class_depth, conds = depth, None
            return
        if name == "line":
            conds = []
            rows.append((report, "line", outer[0], lines, *outer[1:], *(inner or (None,) * 3), None, get("number"), get("hits"), get("branch"), get("condition-coverage"), conds))
            lines += 1
        elif name == "condition":
            if conds is not None:
                conds.append({"number": get("number"), "coverage": get("coverage")})
        elif name == "method" and inner is None:
            inner = (methods, get("name") or "", get("signature") or "")
            rows.append((report, "method", outer[0], methods, *outer[1:], *inner, get("complexity")) + (None,) * 5)
            methods += 1
            method_depth = depth

    def end(_: str) -> None:
        nonlocal outer, inner, depth
        close_source()
        if outer is not None and depth == class_depth:
            outer = None
        if inner is not None and depth == method_depth:
            inner = None
        depth -= 1

    def text(found: str) -> None:
        if source is not None and (source or found.strip()):
            source.append(found)

    def section() -> None:
        if source:
            close_source()

    def node(*_: object) -> None:
        close_source()

    _events(
        data, start, end, CharacterDataHandler=text, CommentHandler=node, ProcessingInstructionHandler=node,
        StartCdataSectionHandler=section, EndCdataSectionHandler=node,
    )
    return rows


def metrics_rows(report: int | None, data: bytes | str) -> list[tuple]:
    """The rows of MEMBERS of one metrics document, in the order their elements end. Types nest; a member's
    complexity is its own metric's, an accessor's stands with the accessor."""
    rows: list[tuple] = []
    space, types, open_members = "", [], []

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal space
        if name == "Namespace":
            space = attributes.get("Name", "")
        elif name == "NamedType":
            types.append(names.without_generics(attributes.get("Name", "")))
        elif name in _MEMBER_ELEMENTS:
            open_members.append([name, attributes.get("Name", ""), None, len(types)])
        elif name == "Metric" and open_members and attributes.get("Name") == "CyclomaticComplexity":
            found = _whole(attributes.get("Value"))
            if found is not None:
                open_members[-1][2] = found

    def end(name: str) -> None:
        nonlocal space
        if name == "Namespace":
            space = ""
        elif name == "NamedType":
            types.pop()
        elif name in _MEMBER_ELEMENTS:
            element, display, complexity, depth = open_members.pop()
            if depth and complexity is not None:
                member, arity, kind = names.member(display, element, types[-1])
                rows.append(((((report or 1) - 1) << 32) | len(rows), ".".join([space] * bool(space) + types), member, kind, arity, complexity, display))

    _events(data, start, end)
    return rows


def _whole(text: str | None) -> int | None:
    """A whole number of 32 bits, with white space and a sign allowed."""
    if text is None or not re.fullmatch(r"\s*[+-]?[0-9]+\s*", text):
        return None
    return int(text) if INT_MIN <= int(text) <= INT_MAX else None


def _walked(rows_of, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        cut = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for report, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held += rows_of(report, data) if data else []
                if len(held) >= BATCH_ROWS:
                    yield cut()
                    held = []
        if held:
            yield cut()

    return run


_TEXT = pa.string()
_ELEMENTS_ARROW = pa.schema(
    [("report_ord", pa.int32()), ("kind", _TEXT), ("class_pos", pa.int32()), ("pos", pa.int32()), ("root", _TEXT), ("filename", _TEXT), ("class", _TEXT), ("method_pos", pa.int32())]
    + [(c, _TEXT) for c in ("method", "signature", "complexity", "number", "hits", "branch", "cover")]
    + [("conds", pa.list_(pa.struct([("number", _TEXT), ("coverage", _TEXT)])))]
)
_MEMBERS_ARROW = pa.schema([("pos", pa.int64()), ("type_name", _TEXT), ("member_name", _TEXT), ("kind", _TEXT), ("arity", pa.int32()), ("complexity", pa.int32()), ("display", _TEXT)])


def parsed(docs: DataFrame) -> DataFrame:
    """The elements (rows of ELEMENTS) of coverage documents (report_ord, xml: bytes or text)."""
    return docs.select(F.col("report_ord").cast("int"), "xml").mapInArrow(_walked(coverage_rows, _ELEMENTS_ARROW), ELEMENTS)


def source_roots(elements: DataFrame) -> DataFrame:
    """report_ord, roots: the normal roots of a document that has any, in order, each once. '' stands for a
    root that changes nothing; alone, it is left out."""
    found = elements.filter("kind = 'root'").groupBy("report_ord").agg(F.array_sort(F.collect_list(F.struct("pos", normal_root(F.col("root")).alias("root")))).alias("found"))
    roots = F.array_distinct(F.col("found.root"))
    return found.select("report_ord", F.when((F.size(roots) == 1) & (roots[0] == ""), F.slice(roots, 1, 0)).otherwise(roots).alias("roots"))


def root_warnings(roots: DataFrame) -> DataFrame:
    """Documents that declare several roots."""
    first = F.element_at("roots", 1)
    how = F.when(first == "", "leaving relative filenames unprefixed (the first declared root is a no-op)").otherwise(F.concat(F.lit("resolving relative filenames against the first ('"), first, F.lit("')")))
    detail = F.concat(F.lit("multiple <source> roots - "), how, F.lit("; files may not be attributable to a unique root"))
    return roots.filter(F.size("roots") > 1).select("report_ord", F.lit("FileIdentityAmbiguous").alias("kind"), F.lit("").alias("file"), F.lit(0).alias("line"), detail.alias("detail"))


def integer(text: Column, kind: str) -> Column:
    """A whole number with white space and a sign allowed; else NULL."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.regexp_replace(text, r"\s", "").try_cast(kind))


def hits_of(text: Column) -> Column:
    value = F.coalesce(integer(text, "bigint"), F.lit(0))
    return F.least(F.greatest(value, F.lit(INT_MIN)), F.lit(INT_MAX)).cast("int")


def outcomes_of(text: Column) -> Column:
    """0 to 2 of a condition's percentage, halves up; NULL if it is no percentage."""
    bare = F.regexp_replace(F.trim(text), "%$", "")
    p = F.when(bare.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(bare).try_cast("double"))
    return F.when((p >= 0) & (p <= 100), F.floor(p / 100 * 2 + 0.5).cast("int"))


def complexity_of(text: Column) -> Column:
    c = F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double"))
    return F.when((c >= 1) & (c <= INT_MAX), F.floor(c + 0.5).cast("int"))


@dataclass(frozen=True)
class Scan:
    """What coverage documents hold, before merging: line_raw, file_seen, roots, warnings."""

    lines: DataFrame
    files: DataFrame
    roots: DataFrame
    warnings: DataFrame


def with_path(elements: DataFrame) -> DataFrame:
    """elements with path: the file key of their class, its file name under the first root that stood before it."""
    rows = elements.withColumn("first", F.coalesce(normal_root(F.col("root")), F.lit("")))
    rows = rows.withColumn("joined", below_root(F.col("filename"), F.col("first")))
    return rows.withColumn("path", drive_upper(F.col("joined"))).drop("first", "joined")


def line_rows(lines: DataFrame) -> DataFrame:
    """report_ord, class_pos, line_pos, path and the numbers of line elements: line, hits, raw_cov, raw_tot,
    conds, and what of hits and branches could not be read. Texts are parsed first, then judged."""
    cover = F.col("cover")
    branch = F.coalesce((F.lower("branch") == "true") & cover.isNotNull(), F.lit(False))
    known = F.transform("conds", lambda c: F.struct(integer(c["number"], "int").alias("key"), outcomes_of(c["coverage"]).alias("value")))
    parsed = with_path(lines).select(
        "report_ord", "class_pos", F.col("pos").alias("line_pos"), "path", integer(F.col("number"), "int").alias("line"), hits_of(F.col("hits")).alias("hits"),
        (F.col("hits").isNotNull() & integer(F.col("hits"), "bigint").isNull()).alias("bad_hits"), F.col("hits").alias("hits_text"), cover.alias("cover_text"),
        branch.alias("branch"), F.when(branch, branch_counts(cover, 1)).alias("p1"), F.when(branch, branch_counts(cover, 2)).alias("p2"),
        F.filter(F.when(F.size("conds") > 0, known), lambda e: e["key"].isNotNull() & e["value"].isNotNull()).alias("known"),
    ).filter("line is not null")
    good = F.col("p1").isNotNull() & F.col("p2").isNotNull()
    keys = F.array_distinct(F.transform("known", lambda e: e["key"]))
    conds = F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_max(F.transform(F.filter("known", lambda e: e["key"] == k), lambda e: e["value"]))))
    return parsed.select(
        "report_ord", "class_pos", "line_pos", "path", "line", "hits", F.when(good, F.col("p1")).alias("raw_cov"), F.when(good, F.col("p2")).alias("raw_tot"),
        F.when(good & (F.col("line") >= 0) & (F.size("known") > 0), conds).alias("conds"), "bad_hits", (F.col("branch") & ~good).alias("bad_branch"), "hits_text", "cover_text",
    )


def branch_counts(cover: Column, i: int) -> Column:
    """Covered (1) or all (2) branches of a condition-coverage text; NULL if it doesn't give them."""
    return F.regexp_extract(cover, r"\((\d+)/(\d+)\)", i).try_cast("int")


def scan(elements: DataFrame) -> Scan:
    """elements: of parsed()."""
    lines = line_rows(elements.filter("kind = 'line'"))
    roots = source_roots(elements)
    order = ["report_ord", "class_pos", "line_pos"]
    bad = [
        lines.filter("bad_hits").select(*order, F.lit("MalformedHits").alias("kind"), F.col("path").alias("file"), "line", F.concat(F.lit("hits='"), "hits_text", F.lit("' could not be parsed - treating as 0")).alias("detail")),
        lines.filter("bad_branch").select(*order, F.lit("MalformedConditionCoverage").alias("kind"), F.col("path").alias("file"), "line", F.concat(F.lit("condition-coverage='"), "cover_text", F.lit("' could not be parsed")).alias("detail")),
        root_warnings(roots).select("report_ord", F.lit(-1).alias("class_pos"), F.lit(-1).alias("line_pos"), "kind", "file", "line", "detail"),
    ]
    warnings = bad[0].unionByName(bad[1]).unionByName(bad[2])
    seen = with_path(elements.filter("kind = 'class'")).groupBy("report_ord", "path").agg(F.min("class_pos").alias("class_pos"))
    return Scan(lines.drop("bad_hits", "bad_branch", "hits_text", "cover_text"), seen, roots, warnings)


def scan_methods(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """method_line and method_hdr rows; lines that stand at the class only are left out."""
    own = (F.col("path").alias("file"), "class", "method", "signature")
    headers = with_path(elements.filter("kind = 'method'")).select(*own, complexity_of(F.col("complexity")).alias("complexity"), F.struct("report_ord", "class_pos", F.col("pos").alias("method_pos")).alias("doc_ord"))
    lines = with_path(elements.filter("kind = 'line' and method_pos is not null")).select(*own, integer(F.col("number"), "int").alias("line"), hits_of(F.col("hits")).alias("hits"))
    return lines.filter("line is not null"), headers


def scan_metrics(docs: DataFrame) -> DataFrame:
    """members rows of metrics documents (report_ord, xml): pos, type_name, member_name, kind, arity, complexity, display."""
    return docs.select(F.col("report_ord").cast("int"), "xml").mapInArrow(_walked(metrics_rows, _MEMBERS_ARROW), MEMBERS)
