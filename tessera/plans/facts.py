"""Coverage facts projected from the provided tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import merge, rollup


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str, conds: bool = False) -> DataFrame:
    """line_raw: three reports (by return flag) over files named by brand and part."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = read(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    branched = F.col("l_orderkey") % 3 == 0
    covered = (F.col("l_linenumber") % 3).cast("int")
    return rows.select(
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("report_ord"),
        F.concat(F.lit("src/"), "p_brand", F.lit("/F"), (F.col("l_partkey") % 40).cast("string"), F.lit(".cs")).alias("path"),
        (F.col("l_orderkey") % 60 + 1).cast("int").alias("line"),
        F.when(F.col("l_discount") < 0.03, 0).otherwise(F.col("l_quantity").cast("int")).alias("hits"),
        F.when(branched, covered).alias("raw_cov"),
        F.when(branched, (F.lit(2) * (1 + F.col("l_suppkey") % 2)).cast("int")).alias("raw_tot"),
        *([F.when(branched, F.create_map(covered, (F.col("l_quantity") % 3).cast("int"))).alias("conds")] if conds else []),
    )


RAW = """raw AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS report_ord,
  'src/' || p_brand || '/F' || CAST(l_partkey % 40 AS VARCHAR) || '.cs' AS path, CAST(l_orderkey % 60 + 1 AS INT) AS line,
  CASE WHEN l_discount < 0.03 THEN 0 ELSE CAST(trunc(l_quantity) AS INT) END AS hits,
  CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_linenumber % 3 AS INT) END AS raw_cov,
  CASE WHEN l_orderkey % 3 = 0 THEN CAST(2 * (1 + l_suppkey % 2) AS INT) END AS raw_tot,
  CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_linenumber % 3 AS INT) END AS cond_no, CAST(trunc(l_quantity) % 3 AS INT) AS cond_cov
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
FACT = f"{RAW}, fact AS (SELECT report_ord, path, line, max(hits) AS hits, max(raw_cov) AS raw_cov, max(raw_tot) AS raw_tot FROM raw GROUP BY ALL)"
MERGED = f"{FACT}, merged AS (SELECT path, line, max(hits) AS hits, max(raw_cov) AS cov, max(raw_tot) AS tot FROM fact GROUP BY ALL)"
_FILE = """SELECT path, count(*) FILTER (hits > 0) AS lines_hit, count(*) AS lines_total,
  CAST(coalesce(sum(cov), 0) AS BIGINT) AS branches_hit, CAST(coalesce(sum(tot), 0) AS BIGINT) AS branches_total,
  count(*) FILTER (hits <> 0 AND NOT coalesce(cov < tot, false)) AS strict, count(*) FILTER (hits <> 0 AND coalesce(cov < tot, false)) AS partial"""
_RATES = """, CAST(lines_hit AS DOUBLE) / nullif(lines_total, 0) AS line_rate, CAST(branches_hit AS DOUBLE) / nullif(branches_total, 0) AS branch_rate,
  CAST(strict AS DOUBLE) / nullif(lines_total, 0) AS strict_rate"""
FILES = f"{MERGED}, sums AS ({_FILE} FROM merged GROUP BY path), files AS (SELECT *{_RATES} FROM sums)"
REPORT = f"""{FILES}, total AS (SELECT count(*) AS files, CAST(sum(lines_hit) AS BIGINT) AS lines_hit, CAST(sum(lines_total) AS BIGINT) AS lines_total,
  CAST(sum(branches_hit) AS BIGINT) AS branches_hit, CAST(sum(branches_total) AS BIGINT) AS branches_total, CAST(sum(strict) AS BIGINT) AS strict,
  CAST(sum(partial) AS BIGINT) AS partial FROM files), report AS (SELECT *{_RATES} FROM total)"""
#: One report's files: {n} is its number, {x} what its paths become.
SIDE = "SELECT {x} AS path, line, max(hits) AS hits FROM raw WHERE report_ord = {n} GROUP BY ALL"
RATED = "SELECT path, CAST(count(*) FILTER (hits > 0) AS DOUBLE) / count(*) AS line_rate FROM {t} GROUP BY path"
DIFF = f"""{RAW}, b AS ({SIDE.format(n=1, x="path")}), a AS ({SIDE.format(n=3, x="path")}), bf AS ({RATED.format(t="b")}), af AS ({RATED.format(t="a")}),
d AS (SELECT coalesce(bf.path, af.path) AS path, bf.line_rate AS before, af.line_rate AS after,
  CASE WHEN bf.path IS NULL THEN af.line_rate WHEN af.path IS NULL THEN -bf.line_rate ELSE af.line_rate - bf.line_rate END AS delta,
  CASE WHEN bf.path IS NULL THEN 'Added' WHEN af.path IS NULL THEN 'Removed' WHEN abs(af.line_rate - bf.line_rate) < 1e-4::DOUBLE THEN 'Unchanged' ELSE 'Modified' END AS change
  FROM bf FULL JOIN af ON bf.path = af.path),
l AS (SELECT * FROM (SELECT coalesce(b.path, a.path) AS path, coalesce(b.line, a.line) AS line, b.hits AS before_hits, a.hits AS after_hits,
  CASE WHEN b.hits IS NULL THEN 'Added' WHEN a.hits IS NULL THEN 'Removed' WHEN b.hits = 0 AND a.hits <> 0 THEN 'NewlyHit' WHEN b.hits <> 0 AND a.hits = 0 THEN 'NewlyMissed' END AS change
  FROM (SELECT * FROM b WHERE path IN (SELECT path FROM af)) b FULL JOIN (SELECT * FROM a WHERE path IN (SELECT path FROM bf)) a ON b.path = a.path AND b.line = a.line)
  WHERE change IS NOT NULL)"""


def facts(spark: SparkSession, sf_dir: str, conds: bool = False) -> DataFrame:
    return merge.line_facts(raw(spark, sf_dir, conds))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maxima over the reports' maxima are maxima over the raw rows: one aggregation."""
    return merge.merged_lines(raw(spark, sf_dir))


def files(spark: SparkSession, sf_dir: str, detail: bool = False) -> DataFrame:
    return rollup.file_rollup(merged(spark, sf_dir), detail=detail)


def side(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The merged lines of report n."""
    return merge.merged_lines(raw(spark, sf_dir).filter(F.col("report_ord") == n))


def methods(spark: SparkSession, sf_dir: str, mangle: bool = False) -> tuple[DataFrame, DataFrame]:
    """method_line and method_hdr: class by brand, method by type. mangle: a third of the rows stand under
    the name of a lambda in the method."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    rows = read(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    inner = (F.col("l_linenumber") % 3 == 0) & (F.col("p_type") != "ECONOMY") if mangle else F.lit(False)
    name = F.when(inner, F.concat(F.lit("<"), "p_type", F.lit(">b__0_"), (F.col("p_size") % 2).cast("string"))).otherwise(F.col("p_type"))
    cls = F.when(inner, F.concat("p_brand", F.lit("/<>c"))).otherwise(F.col("p_brand"))
    rows = rows.select(
        F.concat(F.lit("src/"), "p_brand", F.lit(".cs")).alias("file"), cls.alias("class"), name.alias("method"), F.lit("()").alias("signature"),
        (F.col("l_linenumber") * 100 + F.col("l_orderkey") % 60 + 1).cast("int").alias("line"), F.when(F.col("l_discount") < 0.03, 0).otherwise(F.col("l_quantity").cast("int")).alias("hits"),
        (F.col("p_size") % 12 + 1).cast("int").alias("complexity"), F.col("l_orderkey").alias("doc_ord"),
    )
    key = ["file", "class", "method", "signature"]
    return rows.select(*key, "line", "hits"), rows.groupBy(*key).agg(F.max("complexity").alias("complexity"), F.min("doc_ord").alias("doc_ord"))


METHODS = """mraw AS (SELECT 'src/' || p_brand || '.cs' AS file, p_brand AS cls, p_type AS method, CAST(l_linenumber * 100 + l_orderkey % 60 + 1 AS INT) AS line,
  CASE WHEN l_discount < 0.03 THEN 0 ELSE CAST(trunc(l_quantity) AS INT) END AS hits, CAST(p_size % 12 + 1 AS INT) AS complexity, l_orderkey AS doc_ord
  FROM lineitem JOIN part ON l_partkey = p_partkey),
mline AS (SELECT file, cls, method, line, max(hits) AS hits FROM mraw GROUP BY ALL),
mhdr AS (SELECT file, cls, method, max(complexity) AS complexity, min(doc_ord) AS doc_ord FROM mraw GROUP BY ALL),
meth AS (SELECT file, cls AS class, method, '()' AS signature, count(*) FILTER (hits > 0) AS lines_hit, count(*) AS lines_total, min(line) AS start_line, max(line) AS end_line,
  any_value(complexity) AS complexity, any_value(doc_ord) AS doc_ord, CAST(count(*) FILTER (hits > 0) AS DOUBLE) / count(*) AS line_rate
  FROM mline JOIN mhdr USING (file, cls, method) GROUP BY ALL),
scored AS (SELECT class || '.' || method AS method, file, start_line, complexity, line_rate AS coverage,
  CAST(complexity AS DOUBLE) * complexity * (1.0::DOUBLE - line_rate) * (1.0::DOUBLE - line_rate) * (1.0::DOUBLE - line_rate) + complexity AS score, 'coverageReport' AS source FROM meth)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics members: a method a part, with its size as complexity and parameters by part number; types
    by brand. Every seventh is a property, as whose accessor some methods ask."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("pos"), F.col("p_brand").alias("type_name"), F.when(F.col("p_partkey") % 5 == 0, F.concat("p_type", F.lit("X"))).otherwise(F.col("p_type")).alias("member_name"),
        F.when(F.col("p_partkey") % 7 == 0, "Property").otherwise("Method").alias("kind"), (F.col("p_partkey") % 3).cast("int").alias("arity"), F.col("p_size").alias("complexity"), F.col("p_name").alias("display"),
    )


MEMBERS = """members AS (SELECT CAST(p_partkey AS INT) AS pos, p_brand AS type_name, CASE WHEN p_partkey % 5 = 0 THEN p_type || 'X' ELSE p_type END AS member_name,
  CASE WHEN p_partkey % 7 = 0 THEN 'Property' ELSE 'Method' END AS kind, CAST(p_partkey % 3 AS INT) AS arity, p_size AS complexity, p_name AS display FROM part)"""
