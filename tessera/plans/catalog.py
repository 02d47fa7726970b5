"""The named queries over the provided tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import names, paths, rates
from tessera.operators import crap, diff, merge, rollup
from tessera.plans import facts
from tessera.sources import xml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# merging


@query(f"WITH {facts.MERGED} SELECT path, line, hits FROM merged")
def line_merge(spark, sf_dir):
    return facts.merged(spark, sf_dir).select("path", "line", "hits")


@query(f"WITH {facts.FACT} SELECT * FROM fact")
def report_lines(spark, sf_dir):
    return facts.facts(spark, sf_dir)


@query(f"WITH {facts.MERGED} SELECT path, line, cov, tot FROM merged WHERE tot IS NOT NULL")
def branch_merge(spark, sf_dir):
    return facts.merged(spark, sf_dir).filter("tot is not null").select("path", "line", "cov", "tot")


@query(f"""WITH {facts.FACT},
c AS (SELECT report_ord, path, line, cond_no, max(cond_cov) AS v FROM raw WHERE cond_no IS NOT NULL GROUP BY ALL),
s AS (SELECT c.report_ord, c.path, c.line, list(cond_no ORDER BY cond_no) AS keys FROM c JOIN fact f ON f.report_ord = c.report_ord AND f.path = c.path AND f.line = c.line
      GROUP BY c.report_ord, c.path, c.line, f.raw_tot HAVING count(*) * 2 = f.raw_tot),
p AS (SELECT path, line, count(DISTINCT keys) > 1 AS poisoned FROM s GROUP BY ALL),
u AS (SELECT c.path, c.line, cond_no, max(v) AS v FROM c JOIN s USING (report_ord, path, line) GROUP BY ALL),
g AS (SELECT u.path, u.line, sum(v) AS covered, count(*) * 2 AS total FROM u JOIN p ON p.path = u.path AND p.line = u.line AND NOT p.poisoned GROUP BY ALL),
m AS (SELECT path, line, max(raw_cov) AS raw_cov, max(raw_tot) AS raw_tot FROM fact GROUP BY ALL)
SELECT m.path, m.line, coalesce(p.poisoned, false) AS poisoned, CAST(greatest(raw_cov, coalesce(covered, raw_cov)) AS INT) AS cov, CAST(greatest(raw_tot, coalesce(total, raw_tot)) AS INT) AS tot
FROM m LEFT JOIN p ON p.path = m.path AND p.line = m.line LEFT JOIN g ON g.path = m.path AND g.line = m.line WHERE raw_tot IS NOT NULL""")
def cond_union(spark, sf_dir):
    lines = merge.merged_lines(facts.facts(spark, sf_dir, conds=True))
    return lines.filter("raw_tot is not null").select("path", "line", "poisoned", "cov", "tot")


_STATUS = "CASE WHEN hits = 0 THEN 'Miss' WHEN cov < tot THEN 'Partial' ELSE 'Hit' END"


@query(f"WITH {facts.MERGED} SELECT path, line, {_STATUS} AS status FROM merged")
def line_status(spark, sf_dir):
    return facts.merged(spark, sf_dir).select("path", "line", "status")


@query(f"""WITH {facts.MERGED}, asked AS (SELECT DISTINCT path, CAST(x AS INT) AS line FROM merged, unnest(range(1, 91)) t(x))
SELECT a.path, a.line, m.line IS NOT NULL AS tracked, CASE WHEN m.line IS NULL THEN 'Miss' ELSE {_STATUS} END AS status FROM asked a LEFT JOIN merged m ON m.path = a.path AND m.line = a.line""")
def try_line_status(spark, sf_dir):
    lines = facts.merged(spark, sf_dir)
    asked = lines.select("path").distinct().select("path", F.explode(F.sequence(F.lit(1), F.lit(90))).alias("line"))
    found = asked.join(lines, ["path", "line"], "left")
    return found.select("path", "line", F.col("hits").isNotNull().alias("tracked"), rates.line_status(F.col("hits"), F.col("cov"), F.col("tot")).alias("status"))


# files and reports


@query(f"WITH {facts.FILES} SELECT path, lines_hit, lines_total, branches_hit, branches_total, strict, partial FROM files")
def file_rollup(spark, sf_dir):
    return facts.files(spark, sf_dir).drop("line_rate", "branch_rate", "strict_rate")


@query(f"""WITH {facts.MERGED} SELECT path, coalesce(string_agg(CASE WHEN hits <= 0 THEN CAST(line AS VARCHAR) END, ',' ORDER BY line), '') AS uncovered,
coalesce(string_agg(CASE WHEN cov < tot THEN line || ':' || cov || '/' || tot END, ',' ORDER BY line), '') AS partial FROM merged GROUP BY path""")
def file_details(spark, sf_dir):
    shown = F.transform("partial_branches", lambda b: F.concat(b["line"].cast("string"), F.lit(":"), b["covered"].cast("string"), F.lit("/"), b["total"].cast("string")))
    files = facts.files(spark, sf_dir, detail=True)
    return files.select("path", F.array_join(F.transform("uncovered", lambda x: x.cast("string")), ",").alias("uncovered"), F.array_join(shown, ",").alias("partial"))


@query(f"WITH {facts.REPORT} SELECT * FROM report")
def report_rollup(spark, sf_dir):
    return rollup.report_rollup(facts.files(spark, sf_dir))


@query(f"WITH {facts.FILES} SELECT path, line_rate, branch_rate, strict_rate FROM files")
def strict_rate(spark, sf_dir):
    return facts.files(spark, sf_dir).select("path", "line_rate", "branch_rate", "strict_rate")


@query(f"""WITH {facts.FILES} SELECT path, rint_even(line_rate) AS line_pct, floor(line_rate * 100 * 10 + 1e-9::DOUBLE) / 10 AS line_floor, branches_total > 0 AS has_branch_data FROM files""".replace("rint_even(line_rate)", "round_even(line_rate * 100 * 100, 0) / 100"))
def percents(spark, sf_dir):
    line = F.col("line_rate")
    return facts.files(spark, sf_dir).select("path", rates.percent(line).alias("line_pct"), rates.floored(line).alias("line_floor"), (F.col("branches_total") > 0).alias("has_branch_data"))


@query(f"WITH {facts.FILES} SELECT path, lines_hit, lines_total, line_rate FROM files ORDER BY coalesce(line_rate, -1), path LIMIT 25")
def worst_files_topk(spark, sf_dir):
    return rollup.worst_first(facts.files(spark, sf_dir), "path", 25).select("path", "lines_hit", "lines_total", "line_rate")


@query(f"WITH {facts.FILES} SELECT path, line_rate FROM files WHERE NOT line_rate * 100 >= 85 - 1e-9::DOUBLE")
def below_percent(spark, sf_dir):
    return rollup.below_percent(facts.files(spark, sf_dir), 85).select("path", "line_rate")


@query(f"""WITH {facts.FILES} SELECT path, lines_hit, lines_total FROM files
WHERE NOT ((contains(lower('/' || path), '/f1') OR contains(lower('/' || path), 'brand#2')) AND NOT contains(lower('/' || path), 'f12.cs'))""")
def exclude_keep(spark, sf_dir):
    return rollup.exclude(facts.files(spark, sf_dir), ["/F1", "BRAND#2"], ["f12.CS"]).select("path", "lines_hit", "lines_total")


_GATES = [(0.0, 0.0), (50.0, 0.0), (80.0, 0.0), (85.0, 0.0), (85.0, 30.0), (99.0, 30.0), (99.0, 99.0), (50.0, 99.0), (0.0, 30.0)]


@query(f"""WITH {facts.REPORT}, g(min_line, min_branch) AS (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in _GATES)}),
x AS (SELECT *, line_rate * 100 >= min_line - 1e-9::DOUBLE AS lo, min_branch <= 0 OR coalesce(branch_rate * 100 >= min_branch - 1e-9::DOUBLE, false) AS bo FROM report, g)
SELECT min_line, min_branch, CASE WHEN min_line <= 0 AND min_branch <= 0 THEN 'Disabled' WHEN lines_total = 0 OR (min_branch > 0 AND branches_total = 0) THEN 'NoData' WHEN lo AND bo THEN 'Pass' ELSE 'Fail' END AS outcome,
CASE WHEN min_line <= 0 AND min_branch <= 0 THEN 'no positive threshold - this gate cannot fail' WHEN lo AND bo THEN 'thresholds met' WHEN NOT lo AND NOT bo THEN 'line and branch coverage below threshold'
WHEN NOT lo THEN 'line coverage below threshold' ELSE 'branch coverage below threshold' END AS reason FROM x""")
def gate_grid(spark, sf_dir):
    gates = F.explode(F.array(*[F.struct(F.lit(a).alias("min_line"), F.lit(b).alias("min_branch")) for a, b in _GATES]))
    report = rollup.report_rollup(facts.files(spark, sf_dir)).withColumn("g", gates).select("*", "g.*")
    return rollup.gate_columns(report, F.col("min_line"), F.col("min_branch")).select("min_line", "min_branch", "outcome", "reason")


_EMPTY = [(80.0, 0.0), (0.0, 50.0), (50.0, 50.0), (0.0, 0.0)]
_NOTHING = "report carries no line data - nothing was measured"
_BLIND = "branch threshold of ' || CAST(CAST(min_branch AS INT) AS VARCHAR) || '% requested but the report carries no branch data"


@query(f"""WITH {facts.FILES}, g(min_line, min_branch) AS (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in _EMPTY)}),
x AS (SELECT 'nothing' AS report, min_line, min_branch, CAST(NULL AS DOUBLE) AS line_rate FROM g
  UNION ALL SELECT 'no branches', min_line, min_branch, (SELECT CAST(sum(lines_hit) AS DOUBLE) / sum(lines_total) FROM files) FROM g)
SELECT report, min_line, min_branch, CASE WHEN min_line <= 0 AND min_branch <= 0 THEN 'Disabled' WHEN line_rate IS NULL OR min_branch > 0 THEN 'NoData' WHEN line_rate * 100 >= min_line - 1e-9::DOUBLE THEN 'Pass' ELSE 'Fail' END AS outcome,
CASE WHEN min_line <= 0 AND min_branch <= 0 THEN 'no positive threshold - this gate cannot fail' WHEN line_rate IS NULL THEN '{_NOTHING}' WHEN min_branch > 0 THEN '{_BLIND}'
WHEN line_rate * 100 >= min_line - 1e-9::DOUBLE THEN 'thresholds met' ELSE 'line coverage below threshold' END AS reason FROM x""")
def gate_no_data(spark, sf_dir):
    """The gate over a report without files and one without branch data."""
    gates = F.explode(F.array(*[F.struct(F.lit(a).alias("min_line"), F.lit(b).alias("min_branch")) for a, b in _EMPTY]))
    plain = merge.merged_lines(facts.raw(spark, sf_dir).withColumns({c: F.lit(None).cast("int") for c in ("raw_cov", "raw_tot")}))
    kinds = {"nothing": facts.files(spark, sf_dir).filter(F.lit(False)), "no branches": rollup.file_rollup(plain, detail=False)}
    rows = [rollup.report_rollup(files).select(F.lit(name).alias("report"), "*") for name, files in kinds.items()]
    report = rows[0].unionByName(rows[1]).withColumn("g", gates).select("*", "g.*")
    return rollup.gate_columns(report, F.col("min_line"), F.col("min_branch")).select("report", "min_line", "min_branch", "outcome", "reason")


@query(f"""WITH {facts.FILES} SELECT coalesce(path, 'TOTAL') AS path, CAST(sum(lines_hit) AS BIGINT) AS lines_hit, CAST(sum(lines_total) AS BIGINT) AS lines_total,
CAST(sum(branches_hit) AS BIGINT) AS branches_hit, CAST(sum(branches_total) AS BIGINT) AS branches_total FROM files GROUP BY ROLLUP (path)""")
def table_rows(spark, sf_dir):
    sums = [F.sum(c).alias(c) for c in ("lines_hit", "lines_total", "branches_hit", "branches_total")]
    return facts.files(spark, sf_dir).rollup("path").agg(*sums).withColumn("path", F.coalesce("path", F.lit("TOTAL")))


# warnings


@query(f"""WITH {facts.FACT}, w AS (SELECT *, max(raw_tot) OVER (PARTITION BY path, line ORDER BY report_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM fact)
SELECT report_ord, 'BranchTotalMismatch' AS kind, path AS file, line, 'Total ' || kept || ' vs ' || raw_tot || ' — keeping ' || greatest(kept, raw_tot) AS detail FROM w WHERE kept <> raw_tot""")
def warn_total(spark, sf_dir):
    return merge.total_warnings(facts.facts(spark, sf_dir))


@query(f"""WITH {facts.FACT}, c AS (SELECT DISTINCT report_ord, path, line, cond_no FROM raw WHERE cond_no IS NOT NULL),
s AS (SELECT c.report_ord, c.path, c.line, list(cond_no ORDER BY cond_no) AS keys FROM c JOIN fact f ON f.report_ord = c.report_ord AND f.path = c.path AND f.line = c.line
      GROUP BY c.report_ord, c.path, c.line, f.raw_tot HAVING count(*) * 2 = f.raw_tot),
o AS (SELECT *, first_value(keys) OVER (PARTITION BY path, line ORDER BY report_ord) AS first FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY report_ord) AS n FROM o WHERE first <> keys)
SELECT report_ord, 'ConditionIdentityMismatch' AS kind, path AS file, line, 'condition numbers [' || array_to_string(first, ',') || '] vs [' || array_to_string(keys, ',') || '] - using the line aggregate' AS detail FROM n WHERE n = 1""")
def warn_condition(spark, sf_dir):
    return merge.condition_warnings(facts.facts(spark, sf_dir, conds=True))


_ROOTS = [["/ci/a"], ["/ci/a"], ["/ci/b"]]


@query(f"""WITH {facts.RAW}, f AS (SELECT DISTINCT report_ord, CASE WHEN report_ord = 3 THEN '/ci/b/' ELSE '/ci/a/' END || path AS path FROM raw),
k AS (SELECT path, min(report_ord) AS first, split_part(path, '/', -1) AS name FROM f GROUP BY path)
SELECT b.first AS report_ord, 'FileIdentityAmbiguous' AS kind, a.path AS file, 0 AS line,
'''' || a.path || ''' and ''' || b.path || ''' share a file name under different source roots - if they are the same file, its coverage is double-counted in the merged totals' AS detail
FROM k a JOIN k b ON a.name = b.name AND a.first < b.first AND b.first = 3 WHERE a.path NOT IN (SELECT path FROM f WHERE report_ord = 3)""")
def warn_identity(spark, sf_dir):
    root = F.when(F.col("report_ord") == 3, F.lit("/ci/b/")).otherwise(F.lit("/ci/a/"))
    files = facts.raw(spark, sf_dir).select("report_ord", F.concat(root, "path").alias("path")).distinct()
    steps = spark.createDataFrame([(k + 1,) for k in merge.differing_steps(_ROOTS)], "report_ord int")
    return merge.identity_warnings(files, steps)


# differences


def _sides(spark, sf_dir):
    before, after = facts.side(spark, sf_dir, 1), facts.side(spark, sf_dir, 3)
    return before, after, diff.file_deltas(rollup.file_rollup(before, detail=False), rollup.file_rollup(after, detail=False))


@query(f"WITH {facts.DIFF} SELECT * FROM d")
def file_diff(spark, sf_dir):
    return _sides(spark, sf_dir)[2].select("path", "before", "after", "delta", "change")


@query(f"WITH {facts.DIFF} SELECT path, line, change, before_hits, after_hits FROM l")
def line_diff(spark, sf_dir):
    before, after, deltas = _sides(spark, sf_dir)
    return diff.line_deltas(deltas, before, after).select("path", "line", "change", "before_hits", "after_hits")


@query(f"WITH {facts.DIFF} SELECT path, delta, change FROM d WHERE change <> 'Unchanged' AND delta < 0")
def regressions(spark, sf_dir):
    return diff.regressions(_sides(spark, sf_dir)[2]).select("path", "delta", "change")


@query(f"WITH {facts.DIFF} SELECT path, delta, change FROM d WHERE change <> 'Unchanged' AND delta > 0")
def improvements(spark, sf_dir):
    return diff.improvements(_sides(spark, sf_dir)[2]).select("path", "delta", "change")


@query(f"""WITH {facts.RAW}, b AS (SELECT DISTINCT path FROM raw WHERE report_ord = 1 AND NOT path LIKE '%7.cs'), a AS (SELECT DISTINCT path FROM raw WHERE report_ord = 3 AND NOT path LIKE '%9.cs')
SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'Added' ELSE 'Removed' END AS change FROM b FULL JOIN a ON b.path = a.path WHERE b.path IS NULL OR a.path IS NULL""")
def added_removed(spark, sf_dir):
    before = rollup.file_rollup(facts.side(spark, sf_dir, 1).filter("path not like '%7.cs'"), detail=False)
    after = rollup.file_rollup(facts.side(spark, sf_dir, 3).filter("path not like '%9.cs'"), detail=False)
    deltas = diff.file_deltas(before, after)
    return diff.of_kind(deltas, "Added").unionByName(diff.of_kind(deltas, "Removed")).select("path", "change")


@query(f"WITH {facts.DIFF} SELECT path, change FROM d WHERE path IN (SELECT path FROM l)")
def files_with_changes(spark, sf_dir):
    before, after, deltas = _sides(spark, sf_dir)
    return diff.with_line_changes(deltas, diff.line_deltas(deltas, before, after)).select("path", "change")


@query(f"""WITH {facts.DIFF} SELECT path, count(*) FILTER (change = 'NewlyMissed') AS newly_missed, count(*) FILTER (change = 'NewlyHit') AS newly_hit,
count(*) FILTER (change = 'Added') AS added, count(*) FILTER (change = 'Removed') AS removed FROM l GROUP BY path""")
def change_pivot(spark, sf_dir):
    before, after, deltas = _sides(spark, sf_dir)
    return diff.change_counts(diff.line_deltas(deltas, before, after))


@query(f"WITH {facts.DIFF} SELECT change, count(*) AS lines, CAST(sum(CASE change WHEN 'Added' THEN 1 WHEN 'Removed' THEN -1 WHEN 'NewlyHit' THEN 2 ELSE -2 END) AS BIGINT) AS weight FROM l GROUP BY change")
def change_match(spark, sf_dir):
    before, after, deltas = _sides(spark, sf_dir)
    weight = rates.match_change(F.col("change"), added=F.lit(1), removed=F.lit(-1), newly_hit=F.lit(2), newly_missed=F.lit(-2))
    return diff.line_deltas(deltas, before, after).groupBy("change").agg(F.count("*").alias("lines"), F.sum(weight).alias("weight"))


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with place, their number in the order they come in."""
    return rows.withColumn("at", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("at"))).drop("at")


@query(f"WITH {facts.DIFF} SELECT path, delta, row_number() OVER (ORDER BY delta NULLS FIRST, CASE WHEN before IS NULL THEN 1 ELSE 0 END, path) AS place FROM d")
def diff_order(spark, sf_dir):
    return _numbered(diff.ordered(_sides(spark, sf_dir)[2]).select("path", "delta"))


@query(f"WITH {facts.DIFF} SELECT path, line, change, row_number() OVER (ORDER BY path, line) AS place FROM l")
def line_order(spark, sf_dir):
    before, after, deltas = _sides(spark, sf_dir)
    return _numbered(diff.in_order(diff.line_deltas(deltas, before, after)).select("path", "line", "change"))


def _moved(name: str) -> str:
    return f"""WITH {facts.RAW}, b AS (SELECT DISTINCT {name} AS path FROM raw WHERE report_ord = 1),
a AS (SELECT DISTINCT CASE WHEN path LIKE '%1/F%' THEN '/_/' ELSE '' END || {name} AS path FROM raw WHERE report_ord = 3),
bo AS (SELECT path, split_part(path, '/', -1) AS name FROM b WHERE path NOT IN (SELECT path FROM a)), ao AS (SELECT path, split_part(path, '/', -1) AS name FROM a WHERE path NOT IN (SELECT path FROM b)),
bu AS (SELECT name, any_value(path) AS path FROM bo GROUP BY name HAVING count(*) = 1), au AS (SELECT name, any_value(path) AS path FROM ao GROUP BY name HAVING count(*) = 1)
SELECT bu.path AS before_path, au.path AS after_path FROM bu JOIN au USING (name)
WHERE upper(bu.path) = upper(au.path) OR string_split(bu.path, '/')[-2:] = string_split(au.path, '/')[-2:]"""


def _pairs(spark, sf_dir, path):
    rows = facts.raw(spark, sf_dir)
    prefix = F.when(F.col("path").like("%1/F%"), "/_/").otherwise("")
    before = rows.filter("report_ord = 1").select(path.alias("path")).distinct()
    after = rows.filter("report_ord = 3").select(F.concat(prefix, path).alias("path")).distinct()
    return diff.renamed(before, after)


@query(_moved("path"))
def rename_pairs_ambiguous(spark, sf_dir):
    return _pairs(spark, sf_dir, F.col("path"))


_UNIQUE = "path || '_' || split_part(path, '/', 2) || split_part(path, '/', 3)"


@query(_moved(_UNIQUE))
def rename_pairs(spark, sf_dir):
    part = lambda i: F.element_at(F.split("path", "/"), i)
    return _pairs(spark, sf_dir, F.concat("path", F.lit("_"), part(2), part(3)))


# methods


@query(f"WITH {facts.METHODS} SELECT * EXCLUDE (doc_ord) FROM meth")
def method_rollup(spark, sf_dir):
    return crap.method_rollup(*facts.methods(spark, sf_dir)).drop("doc_ord")


@query(f"WITH {facts.METHODS} SELECT * FROM scored")
def crap_score(spark, sf_dir):
    return crap.analyze(*facts.methods(spark, sf_dir)).methods.drop("doc_ord")


@query(f"WITH {facts.METHODS} SELECT * FROM scored")
def fold_origin(spark, sf_dir):
    return crap.analyze(*facts.methods(spark, sf_dir, mangle=True)).methods.drop("doc_ord")


@query(f"WITH {facts.METHODS} SELECT method, score FROM scored ORDER BY score DESC, method LIMIT 20")
def crap_topk(spark, sf_dir):
    return crap.worst_first(crap.analyze(*facts.methods(spark, sf_dir)).methods, 20, "method").select("method", "score")


@query(f"""WITH {facts.METHODS}, s AS (SELECT count(*) AS scored, count(*) FILTER (score > 6 + 1e-9::DOUBLE) AS above, max(score) AS worst FROM scored)
SELECT *, CASE WHEN scored = 0 THEN 'NoData' WHEN above = 0 THEN 'Pass' ELSE 'Fail' END AS outcome,
CASE WHEN above = 0 THEN 'all ' || scored || ' methods at or below threshold' ELSE above || ' of ' || scored || ' methods above threshold' END AS reason FROM s""")
def crap_gate(spark, sf_dir):
    return crap.evaluate(crap.analyze(*facts.methods(spark, sf_dir)).methods, 6)


_ASK = f"""{facts.METHODS}, {facts.MEMBERS},
ask AS (SELECT class AS t, CASE WHEN hash_get THEN 'get_' || method ELSE method END AS m, CAST(0 AS INT) AS own, line_rate, start_line FROM (SELECT *, length(method) % 2 = 0 AS hash_get FROM meth)),
tried AS (SELECT ask.t, ask.m, own, pos, arity, complexity FROM ask JOIN members ON t = type_name AND m = member_name AND kind = 'Method'),
best AS (SELECT t, m, max(complexity) FILTER (arity = own) AS exact, max(complexity) AS any FROM tried GROUP BY ALL),
prop AS (SELECT type_name AS t, 'get_' || member_name AS m, arg_min(complexity, pos) AS c FROM members WHERE kind = 'Property' GROUP BY ALL),
used AS (SELECT DISTINCT pos FROM tried JOIN best USING (t, m) WHERE exact IS NULL OR arity = own)"""


def _asked(spark, sf_dir):
    lines, headers = facts.methods(spark, sf_dir)
    get = lambda df: df.withColumn("method", F.when(F.length("method") % 2 == 0, F.concat(F.lit("get_"), "method")).otherwise(F.col("method")))
    return crap.analyze(get(lines), get(headers).withColumn("complexity", F.lit(None).cast("int")), facts.members(spark, sf_dir))


@query(f"""WITH {_ASK} SELECT ask.t || '.' || ask.m AS method, coalesce(exact, "any", c) AS complexity, 'metricsFile' AS source FROM ask LEFT JOIN best USING (t, m) LEFT JOIN prop USING (t, m)
WHERE coalesce(exact, "any", c) IS NOT NULL""")
def metrics_join(spark, sf_dir):
    return _asked(spark, sf_dir).methods.select("method", "complexity", "source")


@query(f"WITH {_ASK} SELECT pos, display FROM members WHERE kind = 'Method' AND pos NOT IN (SELECT pos FROM used)")
def unmatched(spark, sf_dir):
    return _asked(spark, sf_dir).unmatched


@query(f"""WITH {_ASK} SELECT ask.t || '.' || ask.m AS method, 'no matching member in the metrics file' AS reason FROM ask LEFT JOIN best USING (t, m) LEFT JOIN prop USING (t, m)
WHERE coalesce(exact, "any", c) IS NULL""")
def unscored(spark, sf_dir):
    return _asked(spark, sf_dir).unscored.select("method", "reason")


# names and paths, built with their answers


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 8 = 6 THEN NULL ELSE 'App.' || p_brand END AS type_key,
CASE WHEN p_partkey % 8 = 6 THEN NULL ELSE 'M' || p_size END AS method_key, CASE WHEN p_partkey % 8 = 6 THEN NULL ELSE p_partkey % 8 NOT IN (0, 7) END AS folded FROM part""")
def demangle(spark, sf_dir):
    m, t, k = F.concat(F.lit("M"), F.col("p_size").cast("string")), F.concat(F.lit("App."), "p_brand"), F.col("p_partkey") % 8
    lit = F.lit
    cls = (
        F.when(k == 1, F.concat(t, lit("/<"), m, lit(">d__3"))).when(k == 2, F.concat(t, lit("/<>c"))).when(k == 3, F.concat(t, lit("/<>c/<<"), m, lit(">b__0_0>d")))
        .when(k == 5, F.concat(t, lit("/<<"), m, lit(">g__L|0_0>d"))).when(k == 6, F.concat(t, lit("/<"), m, lit(">d__1"))).when(k == 7, F.concat(t, lit("`2"))).otherwise(t)
    )
    name = F.when(k.isin(1, 3, 5), "MoveNext").when(k == 2, F.concat(lit("<"), m, lit(">b__0_1"))).when(k == 4, F.concat(lit("<"), m, lit(">g__Local|0_0"))).when(k == 6, "SetStateMachine").otherwise(m)
    rows = facts.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), cls.alias("c"), name.alias("m"))
    return rows.withColumn("x", names.demangled(F.col("c"), F.col("m"))).select("k", "x.*")


@query("SELECT p_partkey AS k, CAST(CASE WHEN p_size % 5 = 4 THEN NULL ELSE p_size % 5 END AS INT) AS arity FROM part")
def signature_arity(spark, sf_dir):
    one = F.lit("Dictionary<int, (string, int[,])>")
    n = F.col("p_size") % 5
    sig = F.when(n == 4, "no parentheses").otherwise(F.concat(F.lit("("), F.array_join(F.when(n > 0, F.array_repeat(one, n)).otherwise(F.array().cast("array<string>")), ", "), F.lit(")")))
    return facts.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), names.arity(sig).alias("arity"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'get_P' WHEN 2 THEN '.ctor' WHEN 3 THEN 'op_Addition' WHEN 4 THEN 'Item' ELSE 'set_Item' END AS member_name,
CAST(CASE p_partkey % 6 WHEN 0 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE NULL END AS INT) AS arity, CASE p_partkey % 6 WHEN 1 THEN 'Accessor' WHEN 5 THEN 'Accessor' WHEN 4 THEN 'Property' ELSE 'Method' END AS kind FROM part""")
def metrics_display(spark, sf_dir):
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("Dictionary<string, int> C.M<T>(int a"), size, F.lit(", List<(int, int)> b)"))).when(k == 1, "int C.P.get").when(k == 2, F.concat(F.lit("C.C(int seed"), size, F.lit(")")))
        .when(k == 3, "C C.operator +(C a, C b)").when(k == 4, "string C.this[int i]").otherwise("string C.this[int i].set")
    )
    rows = facts.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.alias("d"), F.when(k == 4, "Property").otherwise("Method").alias("e"))
    return rows.withColumn("x", names.displayed(F.col("d"), F.col("e"), F.lit("C"))).select("k", "x.member_name", "x.arity", "x.kind")


@query("""SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'C:/repo/' || p_brand WHEN 3 THEN '/repo/' || p_brand WHEN 4 THEN 'src/' || p_brand WHEN 5 THEN '/' ELSE p_brand END AS root FROM part""")
def norm_path(spark, sf_dir):
    b, k = F.col("p_brand"), F.col("p_partkey") % 7
    text = (
        F.when(k == 0, ".").when(k == 1, " ./ ").when(k == 2, F.concat(F.lit("c:\\repo\\"), b, F.lit("\\"))).when(k == 3, F.concat(F.lit("/repo/"), b, F.lit("//")))
        .when(k == 4, F.concat(F.lit("./src/"), b)).when(k == 5, "///").otherwise(F.concat(F.lit(" "), b, F.lit("/ ")))
    )
    return facts.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), paths.normal_root(text).alias("root"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '/r/src/' || p_brand WHEN 1 THEN '/abs/' || p_brand WHEN 2 THEN 'C:/x/' || p_brand WHEN 3 THEN 'src/' || p_brand ELSE '/r/a/' || p_brand END AS path FROM part""")
def resolve_key(spark, sf_dir):
    b, k = F.col("p_brand"), F.col("p_partkey") % 5
    text = F.when(k == 1, F.concat(F.lit("/abs/"), b)).when(k == 2, F.concat(F.lit("c:\\x\\"), b)).when(k == 4, F.concat(F.lit("a\\"), b)).otherwise(F.concat(F.lit("src/"), b))
    roots = F.when(k == 3, F.array(F.lit(""), F.lit("/r"))).when(k == 4, F.array(F.lit("/r/"))).otherwise(F.array(F.lit("/r"), F.lit("/s")))
    return facts.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), paths.file_key(text, roots).alias("path"))


_TOKENS = list(names.OPERATORS.items())


@query(f"""WITH t(i, token, name) AS (VALUES {", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(_TOKENS))})
SELECT p_partkey AS k, name AS member_name, CAST(2 AS INT) AS arity, 'Method' AS kind FROM part JOIN t ON p_partkey % {len(_TOKENS)} = i""")
def operator_tokens(spark, sf_dir):
    """Every operator token, between operands whose types come from the tables."""
    token = F.element_at(F.array(*[F.lit(k) for k, _ in _TOKENS]), (F.col("p_partkey") % len(_TOKENS) + 1).cast("int"))
    text = F.concat(F.lit("C C.operator "), token, F.lit("(C a, List<"), "p_type", F.lit("> b)"))
    rows = facts.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.alias("d"))
    return rows.withColumn("x", names.displayed(F.col("d"), F.lit("Method"), F.lit("C"))).select("k", "x.member_name", "x.arity", "x.kind")


@query("""SELECT p_partkey AS k, p_partkey % 16 < 7 AS generated, p_partkey % 16 BETWEEN 7 AND 12 AS test_code FROM part""")
def rule_lists(spark, sf_dir):
    """The fixed rule lists: each rule occurs in one of sixteen kinds of paths."""
    rules = [*paths.WELL_KNOWN, *paths.TEST_CODE]
    part = F.element_at(F.array(*[F.lit(r.upper()) for r in rules], *[F.lit("/plain/")] * 3), (F.col("p_partkey") % 16 + 1).cast("int"))
    rows = facts.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("src/"), "p_brand", part, "p_type").alias("path"))
    return rows.select("k", paths.excluded(F.col("path"), paths.WELL_KNOWN).alias("generated"), paths.excluded(F.col("path"), paths.TEST_CODE).alias("test_code"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def file_hash(spark, sf_dir):
    return facts.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


# XML built from the tables and read again


def _documents(spark, sf_dir):
    """A coverage document a report and brand (report_ord: 100 times the report and the brand's number), a class a file."""
    rows = facts.raw(spark, sf_dir).select("report_ord", "path", "line", "hits", "raw_cov", "raw_tot")
    text = lambda c: F.col(c).cast("string")
    branch = F.concat(F.lit('" branch="True" condition-coverage="50% ('), text("raw_cov"), F.lit("/"), text("raw_tot"), F.lit(")"))
    line = F.concat(F.lit('<line number="'), text("line"), F.lit('" hits="'), text("hits"), F.coalesce(branch, F.lit("")), F.lit('"/>'))
    rows = rows.select("report_ord", "path", line.alias("x"))
    cls = rows.groupBy("report_ord", "path").agg(F.array_join(F.collect_list("x"), "").alias("x"))
    cls = cls.withColumn("x", F.concat(F.lit('<class name="C" filename="'), "path", F.lit('"><lines>'), "x", F.lit("</lines></class>")))
    number = (F.col("report_ord") * 100 + F.regexp_extract("path", r"(\d+)/", 1).cast("int")).alias("report_ord")
    docs = cls.groupBy(number).agg(F.array_join(F.collect_list("x"), "").alias("x"))
    return docs.select("report_ord", F.concat(F.lit("<coverage><sources><source>.</source></sources><packages><package><classes>"), "x", F.lit("</classes></package></packages></coverage>")).alias("xml"))


@query(f"WITH {facts.FACT} SELECT * FROM fact")
def xml_roundtrip(spark, sf_dir):
    # few but costly rows: a fixed number of partitions, which adaptive execution leaves alone
    docs = _documents(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "report_ord")
    found = xml.scan(xml.parsed(docs)).lines.drop("conds")
    return merge.line_facts(found.withColumn("report_ord", F.floor(F.col("report_ord") / 100).cast("int")))


def _wrapped(body):
    """Class elements as a document; the packages and classes around them."""
    return F.concat(F.lit("<coverage><packages><package><classes>"), body, F.lit("</classes></package></packages></coverage>"))


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and x, the texts x of a key end to end."""
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("x"))


@query(ORACLES["cond_union"])
def xml_conditions(spark, sf_dir):
    """Lines with condition detail, written as XML and read again, then merged."""
    rows = facts.raw(spark, sf_dir, conds=True).select("*", F.explode_outer("conds").alias("no", "outcomes"))
    text = lambda c: F.col(c).cast("string")
    detail = F.concat(F.lit('<conditions><condition number="'), text("no"), F.lit('" type="jump" coverage="'), (F.col("outcomes") * 50).cast("string"), F.lit('%"/></conditions>'))
    branch = F.concat(F.lit('" branch="true" condition-coverage="50% ('), text("raw_cov"), F.lit("/"), text("raw_tot"), F.lit(")"))
    line = F.concat(F.lit('<line number="'), text("line"), F.lit('" hits="'), text("hits"), F.coalesce(branch, F.lit("")), F.lit('">'), F.coalesce(detail, F.lit("")), F.lit("</line>"))
    cls = _joined(rows.select("report_ord", "path", line.alias("x")).distinct(), ["report_ord", "path"])
    cls = cls.withColumn("x", F.concat(F.lit('<class name="C" filename="'), "path", F.lit('"><lines>'), "x", F.lit("</lines></class>")))
    number = (F.col("report_ord") * 100 + F.regexp_extract("path", r"(\d+)/", 1).cast("int")).alias("report_ord")
    docs = _joined(cls.select(number, "x"), ["report_ord"]).select("report_ord", _wrapped(F.col("x")).alias("xml"))
    found = xml.scan(xml.parsed(docs.repartition(spark.sparkContext.defaultParallelism, "report_ord"))).lines
    lines = merge.merged_lines(merge.line_facts(found.withColumn("report_ord", F.floor(F.col("report_ord") / 100).cast("int"))))
    return lines.filter("raw_tot is not null").select("path", "line", "poisoned", "cov", "tot")


@query(f"WITH {facts.METHODS} SELECT * EXCLUDE (doc_ord) FROM meth")
def xml_methods(spark, sf_dir):
    """Methods with complexities, written as XML and read again; a class's own lines count for no method."""
    lines, headers = facts.methods(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    key = ["file", "class", "method", "signature"]
    line = F.concat(F.lit('<line number="'), text("line"), F.lit('" hits="'), text("hits"), F.lit('"/>'))
    body = _joined(lines.select(*key, line.alias("x")).distinct(), key).join(headers, key)
    head = F.concat(F.lit('<method name="'), "method", F.lit('" signature="'), "signature", F.lit('" complexity="'), text("complexity"), F.lit('"><lines>'))
    cls = _joined(body.select("file", "class", F.concat(head, "x", F.lit("</lines></method>")).alias("x")), ["file", "class"])
    whole = F.concat(F.lit('<class name="'), "class", F.lit('" filename="'), "file", F.lit('"><methods>'), "x", F.lit('</methods><lines><line number="9999" hits="1"/></lines></class>'))
    docs = cls.select(F.regexp_extract("file", r"(\d+)", 1).cast("int").alias("report_ord"), _wrapped(whole).alias("xml"))
    return crap.method_rollup(*xml.scan_methods(xml.parsed(docs))).drop("doc_ord")


@query("""SELECT 'Shop.' || p_brand || CASE WHEN p_partkey % 4 = 3 THEN '.Inner' ELSE '' END AS type_name,
CASE p_partkey % 4 WHEN 0 THEN 'M' || p_partkey WHEN 1 THEN 'get_P' || p_partkey WHEN 2 THEN 'P' || p_partkey ELSE 'N' || p_partkey END AS member_name,
CASE p_partkey % 4 WHEN 1 THEN 'Accessor' WHEN 2 THEN 'Property' ELSE 'Method' END AS kind, CAST(CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 3 THEN 0 END AS INT) AS arity, p_size AS complexity FROM part
UNION ALL SELECT 'Shop.' || p_brand, 'P' || p_partkey, 'Property', NULL, 1 FROM part WHERE p_partkey % 4 = 1""")
def xml_metrics(spark, sf_dir):
    """Members of metrics documents, a type a brand with a generic nested type, read in one document a brand."""
    k, n, size = F.col("p_partkey") % 4, F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    metric = lambda c: F.concat(F.lit('<Metrics><Metric Name="CyclomaticComplexity" Value="'), c, F.lit('"/></Metrics>'))
    method = lambda name: F.concat(F.lit('<Method Name="'), name, F.lit('">'), metric(size), F.lit("</Method>"))
    prop = lambda c, inner: F.concat(F.lit('<Property Name="int C.P'), n, F.lit('">'), metric(c), inner, F.lit("</Property>"))
    accessor = F.concat(F.lit("<Accessors>"), method(F.concat(F.lit("int C.P"), n, F.lit(".get"))), F.lit("</Accessors>"))
    member = (
        F.when(k == 0, method(F.concat(F.lit("void C.M"), n, F.lit("(int a)")))).when(k == 1, prop(F.lit("1"), accessor)).when(k == 2, prop(size, F.lit("")))
        .otherwise(method(F.concat(F.lit("void Inner.N"), n, F.lit("()"))))
    )
    rows = facts.read(spark, sf_dir, "part").select("p_brand", (k == 3).alias("inner"), member.alias("x"))
    body = rows.groupBy("p_brand").agg(*[F.array_join(F.collect_list(F.when(c, F.col("x"))), "").alias(name) for c, name in ((F.col("inner"), "nested"), (~F.col("inner"), "own"))])
    nested = F.concat(F.lit('<NamedType Name="Inner&lt;T&gt;"><Members>'), "nested", F.lit("</Members></NamedType>"))
    doc = F.concat(F.lit('<CodeMetricsReport><Targets><Target><Assembly><Namespaces><Namespace Name="Shop"><Types><NamedType Name="'), "p_brand", F.lit('"><Members>'), "own", F.lit("</Members>"), nested, F.lit("</NamedType></Types></Namespace></Namespaces></Assembly></Target></Targets></CodeMetricsReport>"))
    return xml.scan_metrics(body.select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("report_ord"), doc.alias("xml"))).drop("pos", "display")


@query("""SELECT CAST(p_partkey + 1 AS INT) AS k, CASE p_partkey % 7 WHEN 0 THEN '/r/' || p_brand WHEN 1 THEN 'C:/r,/s' WHEN 2 THEN '' WHEN 3 THEN ',/s' WHEN 4 THEN '/s' WHEN 5 THEN '/r&s' ELSE '/late' END AS roots,
CASE p_partkey % 7 WHEN 0 THEN '/r/' || p_brand || '/A.cs' WHEN 1 THEN 'C:/r/A.cs' WHEN 4 THEN '/s/A.cs' WHEN 5 THEN '/r&s/A.cs' ELSE 'A.cs' END AS path FROM part""")
def xml_roots(spark, sf_dir):
    """Source roots of all kinds: with separators, repeated, without effect, after a comment, in a section,
    and after the class that they then don't hold for."""
    k, src = F.col("p_partkey") % 7, lambda *t: F.concat(F.lit("<source>"), *t, F.lit("</source>"))
    lit = F.lit
    roots = (
        F.when(k == 0, src(lit("/r/"), F.col("p_brand"), lit("/"))).when(k == 1, F.concat(src(lit("c:\\r\\")), src(lit("/s")), src(lit("C:/r")))).when(k == 2, src(lit(" ./ ")))
        .when(k == 3, F.concat(src(lit(".")), src(lit("/s")))).when(k == 4, F.concat(src(lit("<!-- no -->/r")), src(lit("")), src(lit("/s<!-- x -->/t")))).when(k == 5, src(lit("<![CDATA[/r&s]]>"))).otherwise("")
    )
    cls = lit('<class name="C" filename="A.cs"><lines><line number="1" hits="1"/></lines></class>')
    doc = F.concat(lit("<coverage><x><sources>"), roots, lit("</sources></x>"), cls, F.when(k == 6, src(lit("/late"))).otherwise(""), lit("</coverage>"))
    found = xml.parsed(facts.read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).cast("int").alias("report_ord"), doc.alias("xml")))
    scan = xml.scan(found)
    rows = scan.files.join(scan.roots, "report_ord", "left")
    return rows.select(F.col("report_ord").alias("k"), F.coalesce(F.array_join("roots", ","), F.lit("")).alias("roots"), "path")


@query("""SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE CAST(l_linenumber AS INT) END AS covered,
CAST(CASE WHEN CAST(trunc(l_quantity) AS INT) * 2 + 1 > 100 THEN NULL WHEN CAST(trunc(l_quantity) AS INT) * 2 + 1 < 25 THEN 0 WHEN CAST(trunc(l_quantity) AS INT) * 2 + 1 < 75 THEN 1 ELSE 2 END AS INT) AS outcomes FROM lineitem""")
def condition_rules(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int") * 2 + 1
    cover = F.when(n % 4 == 3, "50% (x/2)").otherwise(F.concat(F.lit("50% ("), n.cast("string"), F.lit("/9)")))
    part = F.concat(F.lit(" "), q.cast("string"), F.lit("%"))
    return facts.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), xml.branch_counts(cover, 1).alias("covered"), xml.outcomes_of(part).alias("outcomes"))
