"""Mixing sources to target weights: weighted fair queueing over shuffled documents.

Every source serves its documents in a shuffled order, once per pass. A document's virtual finish time
is the source's words up to and with it, divided by the source's target. The documents of all sources,
ordered by that time, are the mix; it ends where the budget of words is used up.

Scale: a source's running total comes from slices of its shuffled order (a fixed part of the hash
range), summed before anything is shuffled by source; so one huge source spreads over all tasks. The cut
is found from histograms of the finish times and a sort of the one narrow bin that holds it.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its own,
last in order; an empty table gives an empty mix; rows that repeat a doc_id, or have none, are documents
of their own, each takes its own turn, by a digest of its text; other columns are carried along, but for
those named like the new ones, which these replace. Sources are names of collections: one row a source goes
through one task to be ranked, 64 bytes each, so a million sources are as good as none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import set_aside, stored, word_count

#: Weights by the sources' code-point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: Rows of a slice are about this many while there are fewer than MAX_SLICES slices.
SLICE_ROWS, MAX_SLICES = 256, 65536
BINS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes: _mix_source, _mix_source_size, a row per source. Adds the weight and target of each.

    Water filling: sources sorted by cap over weight; those before the first that stays under the level
    get their cap, the others the level times their weight. One row per source goes through one task.
    """
    by_name = Window.orderBy("_mix_source")
    w = F.array(*[F.lit(x) for x in weights])
    ranked = sizes.withColumn("_mix_rank", F.row_number().over(by_name)).withColumn("_mix_weight", F.element_at(w, (F.col("_mix_rank") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("_mix_cap", F.col("_mix_source_size") * cap)
    order = Window.orderBy("_mix_ratio", "_mix_rank")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("_mix_ratio", F.col("_mix_cap").cast("double") / F.col("_mix_weight"))
    levels = ranked.withColumn(
        "_mix_level",
        (F.sum("_mix_source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0))) / F.sum("_mix_weight").over(onward),
    )
    level = F.min_by(F.when(F.col("_mix_ratio") > F.col("_mix_level"), F.col("_mix_level")), F.when(F.col("_mix_ratio") > F.col("_mix_level"), F.col("_mix_rank_by_ratio"))).over(everything)
    levels = levels.withColumn("_mix_rank_by_ratio", F.row_number().over(order)).withColumn("_mix_level", level)
    full = F.col("_mix_level").isNull() | (F.col("_mix_level") * F.col("_mix_weight") >= F.col("_mix_cap"))
    return levels.select("_mix_source", "_mix_source_size", F.when(full, F.col("_mix_cap").cast("double")).otherwise(F.col("_mix_level") * F.col("_mix_weight")).alias("_mix_target"))


@set_aside("_mix", "_mix_size", "_mix_source_size", "_mix_target", "_mix_copies", "_mix_time")
def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """docs (doc_id, text, source, ...) and _mix_size, _mix_source_size, _mix_target, _mix_copies, _mix_time.

    _mix_copies: how often the mix takes the document (0 to cap); _mix_time: its first finish time, by
    which the mix is ordered. The total never exceeds share times all sizes.
    """
    slices = max(16, min(MAX_SLICES, docs.count() // SLICE_ROWS))
    # by a hash of the id, then by one of the text; null ids, which share a hash, have slices of their own
    part = lambda digest: F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * slices / F.lit(2**32))
    no_id = F.md5(F.lit(f"{seed}:"))
    by_id, by_text = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), F.md5(F.coalesce("text", F.lit("")))
    within = F.when(by_id < no_id, 0).when(by_id > no_id, slices + 1).otherwise(1 + part(by_text))
    base = (
        docs.withColumn("_mix_size", word_count("text"))
        .withColumn("_mix_source", F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")))
        .withColumn("_mix_order", F.concat(by_id, by_text))
        .withColumn("_mix_slice", part(by_id) * (slices + 2) + within)
    )
    plain = set(docs.columns) == {"doc_id", "text", "source"}
    slim = stored(base.select(*(["doc_id", "source"] if plain else ["doc_id"]), "_mix_size", "_mix_source", "_mix_order", "_mix_slice"))
    by_slice = slim.groupBy("_mix_source", "_mix_slice").agg(F.sum("_mix_size").alias("_mix_sum"))
    targets = source_targets(by_slice.groupBy("_mix_source").agg(F.sum("_mix_sum").alias("_mix_source_size")), weights, share, cap)
    before = Window.partitionBy("_mix_source").orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_slice.select("_mix_source", "_mix_slice", F.coalesce(F.sum("_mix_sum").over(before), F.lit(0)).alias("_mix_offset"))
    offsets = stored(offsets.join(targets, "_mix_source"))

    def timed(rows: DataFrame) -> DataFrame:
        inside = Window.partitionBy("_mix_source", "_mix_slice").orderBy("_mix_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        served = F.sum("_mix_size").over(inside) + F.col("_mix_offset")
        return rows.join(offsets, ["_mix_source", "_mix_slice"]).withColumn("_mix_served", served).withColumn("_mix_time", F.try_divide(F.col("_mix_served").cast("double"), "_mix_target"))

    turn = lambda k: (F.col("_mix_served") + F.col("_mix_source_size") * k).cast("double") / F.col("_mix_target")
    turns = timed(slim).filter("_mix_size > 0 and _mix_target > 0").select(
        "_mix_size", F.explode(F.array(*[F.struct(turn(k).alias("t"), F.col("_mix_order").alias("o"), F.col("doc_id").alias("d"), F.lit(k).alias("k")) for k in range(cap)])).alias("x")
    )
    turns = stored(turns)
    total = slim.agg(F.sum("_mix_size")).first()[0] or 0
    cut = last_turn(turns, total * share)
    if cut is None:
        copies = F.lit(0)
    else:
        t, o, d, _ = cut
        key = lambda k: F.struct(turn(k), F.col("_mix_order"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.lit(k))
        end = F.struct(F.lit(t), F.lit(o), F.lit(-(2**63) if d is None else d).cast("long"), F.lit(cut[3]))
        copies = sum((F.when(key(k) <= end, 1).otherwise(0) for k in range(1, cap)), F.when(key(0) <= end, 1).otherwise(0))
        copies = F.when((F.col("_mix_size") > 0) & (F.col("_mix_target") > 0), copies).otherwise(0)
    out = timed(slim if plain else base).withColumn("_mix_copies", copies)
    return out.drop("_mix_slice", "_mix_offset", "_mix_order", "_mix_served", "_mix_source")


def last_turn(turns: DataFrame, budget: float) -> tuple | None:
    """The last turn that still fits: turns sorted by time, cut where their sizes exceed the budget.

    Two histograms of BINS bins narrow the time; then the turns of one bin are range-sorted and read in
    order up to the cut.
    """
    lo, width, used = 0.0, 4.0 / BINS, 0
    rows = turns
    for level in range(2):
        bin_of = F.least(F.floor((F.col("x.t") - F.lit(lo)) / F.lit(width)), F.lit(BINS))
        bins = rows.groupBy(bin_of.alias("b")).agg(F.sum("_mix_size").alias("s")).orderBy("b").collect()
        found = None
        for r in bins:
            if used + r.s > budget:
                found = r.b
                break
            used += r.s
        if found is None:
            break
        rows = rows.filter(bin_of == found)
        if found == BINS:
            break
        lo, width = lo + found * width, width / BINS
    last = None
    if found is None:  # everything fits
        x = rows.agg(F.max("x").alias("x")).first().x
        return x and (x.t, x.o, x.d, x.k)
    for r in rows.orderBy("x").toLocalIterator():
        if used + r._mix_size > budget:
            break
        used += r._mix_size
        last = (r.x.t, r.x.o, r.x.d, r.x.k)
    if last is None:  # the first turn of the bin is too large already: the last one before the bin
        first = rows.agg(F.min("x.t")).first()[0]
        x = turns.filter(F.col("x.t") < F.lit(first)).agg(F.max("x").alias("x")).first().x
        return x and (x.t, x.o, x.d, x.k)
    return last
