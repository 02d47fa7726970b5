"""Methods and their risk: rollups, folding of compiler-made methods, complexity from metrics, the gate.

method_line: file, class, method, signature, line, hits (several rows a line)
method_hdr: file, class, method, signature, complexity?, doc_ord
members: pos, type_name, member_name, kind, arity?, complexity, display
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import arity, demangled
from tessera.functions.rates import crap, exceeds, rate

_METHOD = ["file", "class", "method", "signature"]
_KEY = ["type_key", "method_key", "sig"]
FOLDED = "<folded>"


def method_rollup(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """A row a method: lines hit and in all, first and last line, largest usable complexity, rate."""
    per_line = lines.groupBy(*_METHOD, "line").agg(F.max("hits").alias("hits"))
    stats = per_line.groupBy(*_METHOD).agg(F.count_if(F.col("hits") > 0).alias("lines_hit"), F.count("*").alias("lines_total"), F.min("line").alias("start_line"), F.max("line").alias("end_line"))
    heads = headers.groupBy(*_METHOD).agg(F.max("complexity").alias("complexity"), F.min("doc_ord").alias("doc_ord"))
    rows = heads.join(stats, _METHOD, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lines_hit", "lines_total", "start_line", "end_line")})
    return rows.withColumn("line_rate", rate(F.col("lines_hit"), F.col("lines_total")))


@dataclass(frozen=True)
class Crap:
    """methods: method, file, start_line, complexity, coverage, score, source, doc_ord. unscored: method,
    file, reason, doc_ord. unmatched: pos, display."""

    methods: DataFrame
    unscored: DataFrame
    unmatched: DataFrame | None


def logical_methods(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Source methods (type_key, method_key, sig, folded, embedded, file, doc_ord) with hit, total and
    start_line of their lines; what compilers made of a method's body is folded into it if exactly one method
    of the name is there.

    Headers and lines go through one flow: they are dealt by the method's name once, and the window and all
    aggregations after it keep that dealing.
    """
    names = headers.select("class", "method").distinct().withColumn("x", demangled(F.col("class"), F.col("method")))
    names = names.select("class", "method", "x.*").filter("type_key is not null")
    none = lambda kind: F.lit(None).cast(kind)
    order = headers.schema["doc_ord"].dataType
    heads = headers.select("class", "method", "signature", "complexity", "file", "doc_ord", none("int").alias("line"), none("int").alias("hits"))
    body = lines.select("class", "method", "signature", none("int").alias("complexity"), none("string").alias("file"), none(order).alias("doc_ord"), "line", "hits")
    rows = heads.unionByName(body).join(names, ["class", "method"]).withColumn("sig", F.when(F.col("folded"), FOLDED).otherwise(F.col("signature")))
    is_head = F.col("line").isNull()
    first = F.when(F.col("line").isNull(), F.struct("folded", "doc_ord"))
    group = rows.groupBy(*_KEY, "folded", "line").agg(F.max("hits").alias("hits"), F.max("complexity").alias("complexity"), F.min_by("file", "doc_ord").alias("file"), F.min("doc_ord").alias("doc_ord"))
    name = Window.partitionBy("type_key", "method_key")
    own = F.when(~F.col("folded") & is_head, F.col("sig"))
    low, high = F.min(own).over(name), F.max(own).over(name)
    group = group.withColumn("origin", F.when(low == high, low)).withColumn("sig", F.when(F.col("folded"), F.coalesce("origin", "sig")).otherwise(F.col("sig")))
    by_line = group.groupBy(*_KEY, "line").agg(
        F.max("hits").alias("hits"), F.max("complexity").alias("embedded"), F.min("folded").alias("folded"),
        F.min_by("file", first).alias("file"), F.min_by("doc_ord", first).alias("doc_ord"),
    )
    head = lambda c: F.max(F.when(is_head, F.col(c))).alias(c)
    found = by_line.groupBy(*_KEY).agg(
        head("folded"), head("embedded"), head("file"), head("doc_ord"),
        F.count_if(F.col("hits") > 0).alias("hit"), F.count("line").alias("total"), F.min("line").alias("start_line"),
    )
    return found.filter("folded is not null")


def analyze(lines: DataFrame, headers: DataFrame, members: DataFrame | None = None) -> Crap:
    """Scores every source method that has lines and a complexity, its own or the metrics file's."""
    found = logical_methods(lines, headers)
    unmatched = None
    if members is None:
        found = found.withColumn("from_metrics", F.lit(None).cast("int"))
    else:
        found, unmatched = _with_metrics(found, members)
    name = F.concat("type_key", F.lit("."), "method_key")
    complexity, coverage = F.coalesce("embedded", "from_metrics"), rate(F.col("hit"), F.col("total"))
    found = found.withColumns({"name": name, "complexity": complexity, "coverage": coverage})
    why = F.when(F.col("total") == 0, "method carries no line data - coverage is unmeasurable").otherwise(
        "no complexity in the coverage report - supply --metrics <file>" if members is None else "no matching member in the metrics file"
    )
    good = (F.col("total") > 0) & F.col("complexity").isNotNull()
    scored = found.filter(good).select(
        F.col("name").alias("method"), "file", "start_line", "complexity", "coverage", crap(F.col("complexity"), F.col("coverage")).alias("score"),
        F.when(F.col("embedded").isNotNull(), "coverageReport").otherwise("metricsFile").alias("source"), "doc_ord",
    )
    return Crap(scored, found.filter(~good).select(F.col("name").alias("method"), "file", why.alias("reason"), "doc_ord"), unmatched)


def _with_metrics(found: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds from_metrics: the largest complexity among the members of the name, those of equal arity
    preferred; else the first property of that name. Also the members nobody asked for.

    Members are grouped by name and arity before they meet the methods, so a name's overloads are a map.
    """
    named = members.filter("kind in ('Method', 'Accessor')").select(F.col("type_name").alias("type_key"), F.col("member_name").alias("method_key"), "pos", "arity", "complexity", "display")
    accessors = members.filter("kind = 'Property'").select(F.col("type_name").alias("type_key"), F.explode(F.array(F.concat(F.lit("get_"), "member_name"), F.concat(F.lit("set_"), "member_name"))).alias("method_key"), "pos", "complexity")
    accessors = accessors.groupBy("type_key", "method_key").agg(F.min_by("complexity", "pos").alias("by_property"))
    per_arity = named.groupBy("type_key", "method_key", "arity").agg(F.max("complexity").alias("most"))
    names = per_arity.groupBy("type_key", "method_key").agg(F.max("most").alias("any"), F.map_from_entries(F.collect_list(F.when(F.col("arity").isNotNull(), F.struct("arity", "most")))).alias("by_arity"))
    asks = F.col("embedded").isNull() & (F.col("total") > 0)
    asking = found.withColumn("own_arity", arity(F.when(asks & ~F.col("folded"), F.col("sig"))))
    out = asking.join(names, ["type_key", "method_key"], "left").join(accessors, ["type_key", "method_key"], "left")
    out = out.withColumn("exact", F.try_element_at("by_arity", F.col("own_arity")))
    by_name = F.when(asks & F.col("any").isNotNull(), F.greatest(F.coalesce("exact", "any"), F.lit(0)))
    out = out.withColumn("from_metrics", F.coalesce(by_name, "by_property"))
    # a method that found its own arity uses the members of that arity, another uses all of its name
    used = out.filter(asks & F.col("any").isNotNull()).groupBy("type_key", "method_key").agg(
        F.max(F.col("exact").isNull()).alias("uses_all"), F.collect_set(F.when(F.col("exact").isNotNull(), F.col("own_arity"))).alias("arities")
    )
    idle = named.join(used, ["type_key", "method_key"], "left")
    idle = idle.filter(~F.coalesce(F.col("uses_all") | F.array_contains("arities", F.col("arity")), F.lit(False)))
    return out.drop("any", "by_arity", "own_arity", "exact", "by_property"), idle.select("pos", "display")


def evaluate(methods: DataFrame, most: float) -> DataFrame:
    """One row: outcome, scored, above, worst and reason, without the count of unscored methods."""
    sums = methods.agg(F.count("*").alias("scored"), F.count_if(exceeds(F.col("score"), most)).alias("above"), F.max("score").alias("worst"))
    outcome = F.when(F.col("scored") == 0, "NoData").when(F.col("above") == 0, "Pass").otherwise("Fail")
    count = lambda c: F.col(c).cast("string")
    reason = (
        F.when(F.col("scored") == 0, "report carries no method-level data - nothing was measured per method")
        .when(F.col("above") == 0, F.concat(F.lit("all "), count("scored"), F.lit(" methods at or below threshold")))
        .otherwise(F.concat(count("above"), F.lit(" of "), count("scored"), F.lit(" methods above threshold")))
    )
    return sums.withColumn("outcome", outcome).withColumn("reason", reason)


def worst_first(methods: DataFrame, top: int | None = None, tie: str = "doc_ord") -> DataFrame:
    rows = methods.orderBy(F.desc("score"), tie)
    return rows if top is None else rows.limit(top)
