"""Line dedup within an edit bound, native: DataFrame functions only.

Lines (split at newlines) are compared by their words. A line goes if an earlier line (by doc_id, then a
hash of the text, which tells rows of one doc_id apart, then place) has the same words or, for lines of at least MIN_WORDS words, is one word edit away: a word
replaced, added or left out. Lines without words always stay.

A deletion neighbourhood finds the edits: every line gives a hashed key for each of its words left out;
lines whose keys meet are joined with the earliest line of that key and verified word by word. A key of a
replaced word keeps the word's place, so all lines under it are one edit from each other, and comparing
each with the earliest misses none; a key of a word left out meets the whole shorter line.

Scale: equal lines are first reduced to their earliest, before the shuffle. Two lines one edit apart share
their first or their last words, a quarter of the line or more, so only lines that share such an end with
another different line give variants; nothing is lost by that. Those lines are numbered in their order, so
that a variant carries a number only. Groups give one row a member, never pairs.
All shuffles carry hashes and coordinates; the texts are shuffled once, and those with variants twice.

Defined cases: null text has no lines and stays null; a null doc_id is above all others; of rows
with equal doc_ids and texts one keeps its lines, the others lose all that have words; very long lines give as many variants as they have words, each in constant
time; an empty table gives an empty result; other columns stay, but for those named like the new ones, which
these replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, WORD, set_aside, stored

MIN_WORDS = 8
_LOW, _HIGH = 0xFFFFFFFF, 32
_ROW = ["line_doc", "line_row"]


def words_of(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def sums(hashes: Column) -> tuple[Column, Column]:
    """Sums of the low and of the high halves of 64-bit hashes: order-free sums that cannot overflow."""
    low = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + h.bitwiseAND(F.lit(_LOW)))
    high = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftright(h, _HIGH))
    return low, high


def ends(words: Column, n: Column, half: Column) -> Column:
    """Hashes of the line's first and last words, half of them: a quarter to a half of the line, a power of
    two; lines whose number of words is a power of two also give those of the lines one word shorter."""

    def pair(c: Column) -> Column:
        return F.array(F.xxhash64(F.lit("first"), c, F.slice(words, 1, c)), F.xxhash64(F.lit("last"), c, F.slice(words, n - c + 1, c)))

    none = F.array().cast("array<bigint>")
    return F.when(n < MIN_WORDS, none).when((n > MIN_WORDS) & (n == half * 2), F.concat(pair(half), pair((half / 2).cast("int")))).otherwise(pair(half))


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with line_doc, its doc_id or NULL_ID, and line_row, which tells rows of one doc_id apart by their texts."""
    return docs.withColumns({"line_doc": F.coalesce("doc_id", F.lit(NULL_ID)), "line_row": F.xxhash64("text")})


def line_table(docs: DataFrame) -> DataFrame:
    """line_doc, line_row, line_at, line_key, line_ends of every line with words."""
    lines = row_keys(docs).select(*_ROW, F.posexplode(F.split("text", "\n")).alias("line_at", "line"))
    # a test of its own: one on the words would have them taken apart twice
    lines = lines.filter(F.col("line").rlike(WORD)).withColumn("words", words_of(F.col("line"))).withColumn("n", F.size("words"))
    lines = lines.withColumn("half", F.pow(F.lit(2.0), F.length(F.bin("n")) - 2).cast("int"))
    key = F.unhex(F.md5(F.array_join("words", " ")))
    return lines.select(*_ROW, "line_at", key.alias("line_key"), ends(F.col("words"), F.col("n"), F.col("half")).alias("line_ends"))


def variants(lines: DataFrame) -> DataFrame:
    """lines (line_no, words): line_var, role, line_no. Role 0: a word replaced, keyed with its
    place; 1: a word left out; 2: the whole line, as what is left of a longer one.

    A replaced word's key sums the other words' hashes with their places; a left-out word's sums the
    hashes of the neighbours in what is left: either takes constant time for each word.
    """
    n, w = F.size("words"), F.col("words")
    placed = F.transform(w, lambda x, i: F.xxhash64(x, i))
    at = lambda a, i: F.element_at(F.col(a), i)
    # neighbours: the pairs (start, w1), (w1, w2), ... (wn, end)
    framed = F.concat(F.array(F.lit("\n")), w, F.array(F.lit("\n\n")))
    rows = lines.withColumn("framed", framed).withColumn("placed", placed).withColumn("pairs", F.zip_with(F.slice("framed", 1, n + 1), F.slice("framed", 2, n + 1), lambda a, b: F.xxhash64(a, b)))
    (pl, ph), (gl, gh) = sums(F.col("placed")), sums(F.col("pairs"))
    rows = rows.withColumns({"n": n, "pl": pl, "ph": ph, "gl": gl, "gh": gh})
    low, high = (lambda h: h.bitwiseAND(F.lit(_LOW))), (lambda h: F.shiftright(h, _HIGH))
    new = lambda i: F.xxhash64(at("framed", i), at("framed", i + 2))

    def replaced(i: Column) -> Column:
        h = at("placed", i)
        return F.struct(F.xxhash64(F.lit(0), F.col("n"), i, F.col("pl") - low(h), F.col("ph") - high(h)).alias("line_var"), F.lit(0).alias("role"))

    def left_out(i: Column) -> Column:
        a, b, c = at("pairs", i), at("pairs", i + 1), new(i)
        key = F.xxhash64(F.lit(1), F.col("n") - 1, F.col("gl") - low(a) - low(b) + low(c), F.col("gh") - high(a) - high(b) + high(c))
        return F.struct(key.alias("line_var"), F.lit(1).alias("role"))

    places = F.sequence(F.lit(1), F.col("n"))
    whole = F.array(F.struct(F.xxhash64(F.lit(1), F.col("n"), F.col("gl"), F.col("gh")).alias("line_var"), F.lit(2).alias("role")))
    every = F.concat(F.transform(places, replaced), F.when(F.col("n") > MIN_WORDS, F.transform(places, left_out)).otherwise(F.slice(whole, 1, 0)), whole)
    return rows.select("line_no", F.explode(every).alias("v")).select("v.line_var", "v.role", "line_no")


def one_edit(a: Column, b: Column) -> Column:
    """Are two lines of words at most one word edit apart."""
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    m = F.size(short)
    first = F.array_position(F.zip_with(F.slice(long, 1, m), short, lambda x, y: x != y), True).cast("int")
    first = F.when(first == 0, m + 1).otherwise(first)
    same = F.slice(long, first + 1, F.greatest(F.size(long) - first, F.lit(0))) == F.slice(short, first + (m == F.size(long)).cast("int"), F.greatest(m - first + (m != F.size(long)).cast("int"), F.lit(0)))
    return (F.size(long) - m <= 1) & same


def near_drops(lines: DataFrame) -> DataFrame:
    """line_doc, line_row, line_at of the lines (line_no, line_doc, line_row, line_at, words) that one of a smaller number is one edit from."""
    keys = stored(variants(lines.select("line_no", "words")))
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("line_no"))).alias(f"m{role}")
    groups = keys.groupBy("line_var").agg(F.count("*").alias("n"), least(0), least(1), least(2)).filter("n > 1")
    lead = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    found = keys.join(groups, "line_var").withColumn("lead", lead).filter(F.col("lead") < F.col("line_no")).select("line_no", "lead").distinct()
    other = lines.select(F.col("line_no").alias("lead"), F.col("words").alias("lead_words"))
    pairs = found.join(lines, "line_no").join(other, "lead")
    return pairs.filter(one_edit(F.col("words"), F.col("lead_words"))).select(*_ROW, "line_at").distinct()


@set_aside("line_", "n_lines", "n_removed", "kept_sha256")
def dedup_lines(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs without the lines that go, and n_lines, n_removed and kept_sha256 (of the kept lines, joined by
    newlines). Without keep_text, text is left out."""
    table = stored(line_table(docs.select("doc_id", "text")))
    place = F.struct(*_ROW, "line_at")
    first = table.groupBy("line_key").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("line_ends").alias("line_ends"))
    first = stored(first)
    again = table.join(first.filter("copies > 1").select("line_key", "first"), "line_key").filter(place > F.col("first"))
    shared = stored(first.select(F.explode("line_ends").alias("end"), "first"))
    twice = shared.groupBy("end").agg(F.count("*").alias("n")).filter("n > 1")
    tried = shared.join(twice, "end", "left_semi").select("first.*").distinct()
    marks = again.select(*_ROW, "line_at", F.lit(False).alias("tried")).unionByName(tried.withColumn("tried", F.lit(True)))
    marks = marks.groupBy(_ROW).agg(F.collect_list(F.when(~F.col("tried"), F.col("line_at"))).alias("line_out"), F.collect_list(F.when(F.col("tried"), F.col("line_at"))).alias("line_try"))
    none = F.array().cast("array<int>")
    joined = row_keys(docs).join(marks, _ROW, "left").withColumns({c: F.coalesce(c, none) for c in ("line_out", "line_try")})
    # of equal rows all but one find their lines in that one
    joined = joined.withColumn("line_copy", F.row_number().over(Window.partitionBy(_ROW).orderBy("line_row")) > 1)
    lines = F.split("text", "\n")
    worded = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
    joined = joined.withColumns({"line_out": F.when(F.col("line_copy") & F.col("text").isNotNull(), worded).otherwise(F.col("line_out")), "line_try": F.when(F.col("line_copy"), none).otherwise(F.col("line_try"))}).drop("line_copy")

    def finished(rows: DataFrame, out: Column) -> DataFrame:
        lines = F.split("text", "\n")
        gone = F.map_from_arrays(out, F.transform(out, lambda _: F.lit(True)))
        kept = F.when(F.size(out) == 0, F.col("text")).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.map_contains_key(gone, i)), "\n"))
        counts = {"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "n_removed": F.size(out).cast("long"), "kept_sha256": F.sha2(F.coalesce(kept, F.lit("")), 256)}
        counts["n_lines"] = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
        return rows.withColumns(counts | {"text": kept})

    # what has no line to try is finished here; the others wait for their lines' verdicts
    wait = F.size("line_try") > 0
    half = finished(joined, F.when(wait, none).otherwise(F.array_distinct("line_out")))
    if not keep_text:
        half = half.withColumn("text", F.when(wait, F.col("text")))
    half = stored(half)
    asked = half.filter(wait).withColumn("lines", F.split("text", "\n")).select(*_ROW, F.explode(F.array_distinct("line_try")).alias("line_at"), "lines")
    asked = asked.select(*_ROW, "line_at", F.element_at("lines", F.col("line_at") + 1).alias("line")).orderBy(*_ROW, "line_at")
    # numbers that rise in the order of the sort
    near = near_drops(stored(asked.select(F.monotonically_increasing_id().alias("line_no"), *_ROW, "line_at", words_of(F.col("line")).alias("words"))))
    near = near.groupBy(_ROW).agg(F.collect_list("line_at").alias("line_near"))
    late = half.filter(wait).join(near, _ROW, "left")
    late = finished(late.drop("n_lines", "n_removed", "kept_sha256"), F.array_distinct(F.concat("line_out", F.coalesce("line_near", none))))
    names = [c for c in docs.columns if keep_text or c != "text"] + ["n_lines", "n_removed", "kept_sha256"]
    return half.filter(~wait).select(names).unionByName(late.select(names))
