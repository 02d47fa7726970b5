"""Merging reports: line facts by maximum, condition detail by union or poisoning, and the warnings of the fold.

Numbers don't depend on the reports' order, so merging is one aggregation over all reports with partial
sums before the shuffle. Warnings do depend on it; they are windows over the reports of a line.

line_raw: report_ord, path, line, hits, raw_cov?, raw_tot?, conds map<int,int>? (several rows a line)
line_fact: the same, one row a report and line
line_merged: path, line, hits, raw_cov?, raw_tot?, conds?, poisoned, cov?, tot?, status
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import file_name
from tessera.functions.rates import line_status

_REPORT = ["report_ord", "path", "line"]


_MOST = ("hits", "raw_cov", "raw_tot")


def _maxima(rows: DataFrame, keys: list[str], more: list[Column]) -> DataFrame:
    """A row for the keys: maxima, and conds, each condition's largest value, NULL for none.

    Conditions are rows of their own first, so that they are reduced by key before the shuffle; a line's map
    is put together from one entry a condition.
    """
    names = [c for c in rows.columns if c not in {*keys, *_MOST, "conds"}]
    each = rows.select(*keys, *_MOST, *names, F.explode_outer("conds").alias("cond", "value"))
    per_cond = each.groupBy(*keys, "cond").agg(*[F.max(c).alias(c) for c in (*_MOST, "value")], *more)
    entry = F.when(F.col("cond").isNotNull(), F.struct(F.col("cond").alias("key"), "value"))
    folded = [(F.min if c == "least" else F.max)(c).alias(c) for c in ("least", "most", "poisoned") if c in per_cond.columns]
    out = per_cond.groupBy(*keys).agg(*[F.max(c).alias(c) for c in _MOST], F.array_sort(F.collect_list(entry)).alias("entries"), *folded)
    return out.withColumn("conds", F.when(F.size("entries") > 0, F.map_from_entries("entries"))).drop("entries")


def line_facts(raw: DataFrame) -> DataFrame:
    """One row a report and line. Condition detail stays only if it accounts for all branches of the line."""
    if "conds" not in raw.columns:
        return raw.groupBy(*_REPORT).agg(*[F.max(c).alias(c) for c in _MOST])
    found = _maxima(raw, _REPORT, [])
    return found.withColumn("conds", F.when(F.size("conds") * 2 == F.col("raw_tot"), F.col("conds"))).select(*_REPORT, *_MOST, "conds")


def merged_lines(facts: DataFrame) -> DataFrame:
    """All reports as one: maxima; conditions united if all reports with detail name the same ones, else
    poisoned. facts that are merged already (with poisoned) may be among them."""
    if "conds" not in facts.columns:
        found = facts.groupBy("path", "line").agg(*[F.max(c).alias(c) for c in _MOST])
        return presented(found.withColumn("poisoned", F.lit(False)).withColumn("conds", F.lit(None).cast("map<int,int>")))
    named = F.when(F.col("conds").isNotNull(), F.xxhash64(F.array_sort(F.map_keys("conds"))))
    before = F.coalesce(F.col("poisoned"), F.lit(False)) if "poisoned" in facts.columns else F.lit(False)
    rows = facts.select("path", "line", *_MOST, "conds", named.alias("named"), before.alias("spoilt"))
    found = _maxima(rows, ["path", "line"], [F.min("named").alias("least"), F.max("named").alias("most"), F.max("spoilt").alias("poisoned")])
    poisoned = F.col("poisoned") | F.coalesce(F.col("least") != F.col("most"), F.lit(False))
    found = found.withColumn("poisoned", poisoned).withColumn("conds", F.when(~F.col("poisoned"), F.col("conds")))
    return presented(found.select("path", "line", *_MOST, "poisoned", "conds"))


def presented(lines: DataFrame) -> DataFrame:
    """Adds cov and tot, raised by what the condition detail accounts for, and the line's status."""
    outcomes = F.aggregate(F.map_values("conds"), F.lit(0), lambda a, v: a + v)
    whole = F.col("conds").isNotNull() & (F.size("conds") > 0)
    cov = F.when(whole, F.greatest(F.col("raw_cov"), outcomes)).otherwise(F.col("raw_cov"))
    tot = F.when(whole, F.greatest(F.col("raw_tot"), F.size("conds") * 2)).otherwise(F.col("raw_tot"))
    return lines.withColumn("cov", cov).withColumn("tot", tot).withColumn("status", line_status(F.col("hits"), F.col("cov"), F.col("tot")))


def total_warnings(facts: DataFrame) -> DataFrame:
    """A report whose branch total differs from what the reports before it gave for the line."""
    before = Window.partitionBy("path", "line").orderBy("report_ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = facts.select(*_REPORT, "raw_tot").withColumn("kept", F.max("raw_tot").over(before)).filter(F.col("kept") != F.col("raw_tot"))
    detail = F.concat(F.lit("Total "), F.col("kept"), F.lit(" vs "), F.col("raw_tot"), F.lit(" — keeping "), F.greatest("kept", "raw_tot"))
    return rows.select("report_ord", F.lit("BranchTotalMismatch").alias("kind"), F.col("path").alias("file"), "line", detail.alias("detail"))


def condition_warnings(facts: DataFrame) -> DataFrame:
    """The first report of a line that names other conditions than the first one did."""
    order = Window.partitionBy("path", "line").orderBy("report_ord")
    rows = facts.filter("conds is not null").select(*_REPORT, F.array_sort(F.map_keys("conds")).alias("keys"))
    rows = rows.withColumn("first", F.first("keys").over(order)).filter(F.col("first") != F.col("keys"))
    rows = rows.withColumn("n", F.row_number().over(order)).filter("n = 1")
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    detail = F.concat(F.lit("condition numbers ["), show(F.col("first")), F.lit("] vs ["), show(F.col("keys")), F.lit("] - using the line aggregate"))
    return rows.select("report_ord", F.lit("ConditionIdentityMismatch").alias("kind"), F.col("path").alias("file"), "line", detail.alias("detail"))


def differing_steps(roots: list[list[str]]) -> list[int]:
    """Steps of the fold (from 1) at which the report's normal roots differ from those gathered before it."""
    gathered, steps = list(roots[0]) if roots else [], []
    for k, own in enumerate(roots[1:], 1):
        if (gathered or own) and gathered != list(own):
            steps.append(k)
        gathered += [r for r in dict.fromkeys(own) if r not in gathered]
    return steps


def identity_warnings(files: DataFrame, steps: DataFrame) -> DataFrame:
    """Files known before a step, and files only that step's report has, of one name but different paths.

    files: report_ord, path. steps: report_ord, the steps at which roots differ. One row a pair, as the
    warning has it.
    """
    known = files.groupBy("path").agg(F.min("report_ord").alias("first")).withColumn("name", file_name(F.col("path")))
    fresh = known.join(steps.select(F.col("report_ord").alias("first")), "first", "left_semi").select(F.col("path").alias("pb"), F.col("first").alias("step"), "name")
    pairs = fresh.join(known.select(F.col("path").alias("pa"), F.col("first").alias("pa_first"), "name"), "name").filter("pa_first < step")
    pairs = pairs.join(files.select(F.col("report_ord").alias("step"), F.col("path").alias("pa")), ["step", "pa"], "left_anti")
    detail = F.concat(F.lit("'"), F.col("pa"), F.lit("' and '"), F.col("pb"), F.lit("' share a file name under different source roots - if they are the same file, its coverage is double-counted in the merged totals"))
    return pairs.select(F.col("step").alias("report_ord"), F.lit("FileIdentityAmbiguous").alias("kind"), F.col("pa").alias("file"), F.lit(0).alias("line"), detail.alias("detail"))
