"""Comparing two reports: files by path, leftovers by name, lines within paired files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import file_name, same_file_evidence
from tessera.functions.rates import file_change, line_change


def _by_path(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, b, a: what each side has of a path (structs of path, rate and ord), NULL for nothing."""

    def side(df: DataFrame, name: str) -> DataFrame:
        more = [F.col(c) if c in df.columns else F.lit(None) for c in ("line_rate", "doc_ord")]
        return df.select("path", F.lit(name).alias("side"), F.struct("path", more[0].cast("double").alias("rate"), more[1].alias("ord")).alias("own"))

    rows = side(before, "b").unionByName(side(after, "a"))
    own = lambda name: F.first(F.when(F.col("side") == name, F.col("own")), ignorenulls=True).alias(name)
    return rows.groupBy("path").agg(own("b"), own("a"))


def _renamed(paths: DataFrame, roots_differ: bool) -> DataFrame:
    """b, a: the files on one side only whose name is the only one of its kind on both sides, paired."""
    left = paths.filter("b is null or a is null").withColumn("name", file_name(F.col("path")))
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    pairs = left.groupBy("name").agg(F.count("b").alias("n_b"), F.count("a").alias("n_a"), one("b"), one("a")).filter("n_b = 1 and n_a = 1")
    return (pairs if roots_differ else pairs.filter(same_file_evidence(F.col("b.path"), F.col("a.path")))).select("b", "a")


def renamed(before: DataFrame, after: DataFrame, roots_differ: bool = False) -> DataFrame:
    """before_path, after_path of files on one side only whose name is the only one of its kind on both
    sides, if the roots differ or the paths themselves are evidence. before, after: path."""
    pairs = _renamed(_by_path(before.select("path").distinct(), after.select("path").distinct()), roots_differ)
    return pairs.select(F.col("b.path").alias("before_path"), F.col("a.path").alias("after_path"))


def file_deltas(before: DataFrame, after: DataFrame, roots_differ: bool = False) -> DataFrame:
    """path, before, after, delta, change, before_path, after_path and the order of encounter.

    before, after: path, line_rate and, if given, doc_ord. Paired files stand under their path after.
    Both sides meet in one aggregation by path; only the few renamed files are joined to it again.
    """
    paths = _by_path(before, after)
    moved = F.explode(F.array(F.struct(F.col("a.path").alias("path"), F.col("b").alias("from"), F.lit(False).alias("gone")), F.struct(F.col("b.path").alias("path"), F.col("b").alias("from"), F.lit(True).alias("gone"))))
    pairs = _renamed(paths, roots_differ).select(moved.alias("x")).select("x.*")
    rows = paths.join(pairs, "path", "left").filter("gone is null or not gone").withColumn("b", F.coalesce("b", "from"))
    in_before, in_after = F.col("before_path").isNotNull(), F.col("after_path").isNotNull()
    rows = rows.select("path", F.col("b.rate").alias("before"), F.col("a.rate").alias("after"), F.col("b.path").alias("before_path"), F.col("a.path").alias("after_path"), F.coalesce("b.ord", "a.ord").alias("ord"))
    delta = F.when(~in_before, F.col("after")).when(~in_after, -F.col("before")).otherwise(F.col("after") - F.col("before"))
    return rows.select(
        "path", "before", "after", delta.alias("delta"), file_change(F.col("before"), F.col("after"), in_before, in_after).alias("change"), "before_path", "after_path",
        F.struct(F.when(in_before, 0).otherwise(1).alias("side"), "ord").alias("enc_ord"),
    )


def line_deltas(deltas: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """path, line, change, before_hits, after_hits of lines that came, went or flipped in paired files.

    deltas: of file_deltas. before, after: path, line, hits. Both sides are named by their pair in one join
    and meet in one aggregation.
    """
    pairs = deltas.filter("before_path is not null and after_path is not null")
    own = F.explode(F.array(F.struct(F.lit("b").alias("side"), F.col("before_path").alias("own")), F.struct(F.lit("a").alias("side"), F.col("after_path").alias("own"))))
    names = pairs.select("path", own.alias("x")).select("path", "x.*")
    side = lambda df, name: df.select(F.lit(name).alias("side"), F.col("path").alias("own"), "line", "hits")
    rows = side(before, "b").unionByName(side(after, "a")).join(names, ["side", "own"])
    hits = lambda name: F.max(F.when(F.col("side") == name, F.col("hits")))
    rows = rows.groupBy("path", "line").agg(hits("b").alias("before_hits"), hits("a").alias("after_hits"))
    return rows.withColumn("change", line_change(F.col("before_hits"), F.col("after_hits"))).filter("change is not null")


def ordered(deltas: DataFrame) -> DataFrame:
    """Largest loss first, unmeasured before all; ties as encountered."""
    return deltas.orderBy(F.asc_nulls_first("delta"), "enc_ord", "path")


def in_order(lines: DataFrame) -> DataFrame:
    """Line changes by path and line."""
    return lines.orderBy("path", "line")


def regressions(deltas: DataFrame) -> DataFrame:
    return deltas.filter((F.col("change") != "Unchanged") & (F.col("delta") < 0))


def improvements(deltas: DataFrame) -> DataFrame:
    return deltas.filter((F.col("change") != "Unchanged") & (F.col("delta") > 0))


def of_kind(deltas: DataFrame, change: str) -> DataFrame:
    """Added, Removed, Modified or Unchanged files."""
    return deltas.filter(F.col("change") == change)


def with_line_changes(deltas: DataFrame, lines: DataFrame) -> DataFrame:
    return deltas.join(lines.select("path"), "path", "left_semi")


def change_counts(lines: DataFrame) -> DataFrame:
    """A row a path: how many lines were newly missed, newly hit, added, removed."""
    kinds = {"NewlyMissed": "newly_missed", "NewlyHit": "newly_hit", "Added": "added", "Removed": "removed"}
    return lines.groupBy("path").agg(*[F.count_if(F.col("change") == k).alias(v) for k, v in kinds.items()])
