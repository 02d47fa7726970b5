"""File identity: separators, roots, keys and names as columns, and exclusion rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What generated code and build output is named.
WELL_KNOWN = (".g.cs", ".designer.cs", "/obj/", "/bin/", "/Migrations/", "/GlobalUsings.cs", "/Program.cs")
#: What test code is named, with either separator.
TEST_CODE = (".Tests/", ".Tests\\", "TestSupport/", "TestSupport\\", "/TestFixtures/", "\\TestFixtures\\")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def drive_upper(path: Column) -> Column:
    """Upper-case drive letter of x:/..."""
    return F.concat(F.upper(F.regexp_extract(path, "^([a-z]):/", 1)), F.regexp_replace(path, "^[a-z](?=:/)", ""))


def normal_root(root: Column) -> Column:
    """The identity of a source root: '' for the current folder; no slash at the end, but for the top's own."""
    r = slashes(F.regexp_replace(root, r"^\s+|\s+$", ""))
    r = F.regexp_replace(F.regexp_replace(r, r"^\./", ""), r"^\.$", "")
    return F.regexp_replace(drive_upper(r), "(?<=.)/+$", "")


def rooted(path: Column) -> Column:
    return path.rlike("^(/|[A-Za-z]:)")


def below_root(filename: Column, root: Column) -> Column:
    """The path under the root, unless the name is rooted itself."""
    name = slashes(filename)
    below = F.when((root == "") | rooted(name), "").otherwise(F.regexp_replace(F.concat(root, F.lit("/")), "//$", "/"))
    return F.concat(below, name)


def file_key(filename: Column, roots: Column) -> Column:
    """The path that identifies a file: joined to the first root unless it is rooted itself."""
    return drive_upper(below_root(filename, F.coalesce(F.try_element_at(roots, F.lit(1)), F.lit(""))))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def same_file_evidence(before: Column, after: Column) -> Column:
    """Equal but for case, or the last two segments equal."""
    b, a = F.split(before, "/"), F.split(after, "/")
    tail = lambda x: F.slice(x, -2, 2)
    both = (F.size(b) >= 2) & (F.size(a) >= 2)
    return (F.upper(before) == F.upper(after)) | (both & (tail(b) == tail(a)))


def excluded(path: Column, rules: Sequence[str], keep: Sequence[str] = ()) -> Column:
    """Does a rule, and no keep, occur in the path (with a / before it), whatever the case."""
    probe = F.lower(F.concat(F.lit("/"), path))
    hit = lambda xs: F.lit(False) if not xs else _any([F.contains(probe, F.lit(x.lower())) for x in xs])
    return hit(rules) & ~hit(keep)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
