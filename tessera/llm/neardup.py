"""MinHash near-dedup: weighted sampling over TF-IDF shingles, bands, and exact weighted Jaccard.

A text's shingles are its runs of five words; a shingle weighs its count times the mean inverse document
frequency of its words. Improved consistent weighted sampling draws SAMPLES shingles a text such that two
texts draw the same one with probability equal to their weighted Jaccard similarity. Texts that agree in
all draws of a band are candidates; their similarity is then computed exactly, and texts of THRESHOLD or
more are linked. Linked texts, and texts linked through others, are one class.

Candidates of a band key are not paired with each other. First each is compared with the key's lightest
text (the leader), and the links found give classes. A key whose other texts are of one class then has
nothing left to link. The texts of all other keys (the contested ones) are joined by prefixes, which loses
no link: shingles are ordered from those in the fewest contested texts on; the first shingle that two texts
share leaves each of them at most the weight that follows it, so a pair is compared only if that could be
enough, and only if its classes differ. In a group of texts that resemble each other less than THRESHOLD
asks for, the rare shingles that each has of its own use up that weight, so hardly a pair is left. The entries
of a shingle's list are first compared with one of its largest class, which joins classes that only their
leaders kept apart, then with all entries of other classes, in parts of PART entries. So the work is linear
in a large group of copies, near copies or texts that share a passage, and there are three comparisons,
whatever the size of the groups.

Document frequencies are counted over all documents in BINS hashed bins (frequent words keep their own
counts; rare ones share bins), so the table has one size for any corpus.

Scale: equal texts are reduced to one by digests. Shuffled: bin counts, band keys (twice), the texts that
share a key, once to their ids and once for each leader they are compared with, and the shingles of
contested texts. A leader's texts are dealt in parts of PART. Classes come from joins of the links with
smallest labels, a logarithmic number of rounds; nothing but the bins is collected.

Defined cases: null and blank texts are only equal to themselves among rows (null is no copy of anything);
texts under five words are grouped by equal text only; a null doc_id is above all others; a document is known by a hash of its doc_id
and text, so rows of one doc_id and different texts, as null ids, are documents of their own (a class of null ids
only has a null class_id); an empty table gives an empty result; other columns stay where rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, gram_hashes, mix64, runs, set_aside, spread, stored, text_batches, text_bytes, word_bounds, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: 17 bands of 6 draws: two texts of similarity 0.8 share a key with probability 0.994, of 0.85 with 0.9998.
BANDS, ROWS = 17, 6
#: At most so many texts of a leader, or entries of a shingle's list, are dealt to one task together.
PART = 1 << 11
BINS, BLOCKS = 1 << 18, 64
BATCH_BYTES = 4 << 20
TABLE = 1 << 14
_U = np.uint64


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and per text the index of its first (len+1 values)."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), first


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have a word of each bin, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in text_batches(batches, "text", BATCH_BYTES):
            words, first = text_words(batch.column(0))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            pairs = np.unique((doc << 18) | (words >> _U(46)).astype(np.int64))
            total += np.bincount(pairs & (BINS - 1), minlength=BINS)
        parts = total.reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in table.column("counts"))
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    if not rows:
        return np.zeros(BINS, np.int64), 0
    return np.concatenate([np.frombuffer(r.counts, "<i8") for r in sorted(rows, key=lambda r: r.block)]), docs.count()


def word_weights(frequencies: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency by bin, positive for words of every document too."""
    return (1 + np.log((1 + n) / (1 + frequencies))).astype(np.float32)


def shingles(words: np.ndarray, first: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text in turn its different shingles, sorted: hash, weight; and the index of each text's first."""
    counts = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(len(counts) + 1, np.int64)
    at = spread(first[:-1], counts)
    sums = np.concatenate([[0.0], np.cumsum(idf[(words >> _U(46)).astype(np.int64)], dtype=np.float64)])
    mean = ((sums[SHINGLE:] - sums[:-SHINGLE]) / SHINGLE)[at]
    hashes = gram_hashes(words, SHINGLE, seed=3)[at]
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order], kind="stable")]
    hashes, doc, mean = hashes[order], doc[order], mean[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(hashes)))
    # rounded, so that a shingle weighs the same wherever it stands
    weights = np.round(mean[heads], 3).astype(np.float32) * times.astype(np.float32)
    return hashes[heads], weights, np.searchsorted(doc[heads], np.arange(len(counts) + 1))


def sample_tables(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each draw, TABLE triples of what the method draws for a shingle: r and ln c of gamma(2, 1), beta uniform."""
    rng = np.random.default_rng(20240601)
    r = rng.gamma(2.0, 1.0, (samples, TABLE)).astype(np.float32)
    c = np.log(rng.gamma(2.0, 1.0, (samples, TABLE))).astype(np.float32)
    return r, c, rng.random((samples, TABLE), dtype=np.float32)


def draws(hashes: np.ndarray, weights: np.ndarray, first: np.ndarray, tables: tuple, n: int = BANDS * ROWS) -> np.ndarray:
    """n draws a text, a row a text; texts without shingles get zeros.

    A draw: t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r; the shingle of the smallest a, with
    its t. A shingle's r, c and beta come from a table, at a place that its hash gives for this draw.
    """
    out = np.zeros((len(first) - 1, n), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    heads, sizes = first[full], np.diff(first)[full]
    log_w = np.log(weights)
    group = np.repeat(np.arange(len(full)), sizes)
    for k, (r_of, c_of, b_of) in enumerate(zip(*tables, strict=True)):
        salt = mix64(np.array([k + 1], np.uint64))[0] | _U(1)
        place = ((hashes * salt) >> _U(50)).astype(np.intp)
        r, beta = r_of[place], b_of[place]
        t = np.floor(log_w / r + beta)
        a = c_of[place] - r * (t - beta) - r
        low = np.minimum.reduceat(a, heads)
        hit = np.flatnonzero(a == low[group])
        who = group[hit]
        value = mix64(hashes[hit] ^ mix64(t[hit].astype(np.int64).astype(np.uint64)))
        out[full, k] = np.minimum.reduceat(value, runs(who))
    return out


def band_keys(drawn: np.ndarray, rows: int = 4) -> np.ndarray:
    """A key for each band of rows draws."""
    keys = np.zeros((len(drawn), drawn.shape[1] // rows), np.uint64)
    for k in range(drawn.shape[1]):
        keys[:, k // rows] = mix64(keys[:, k // rows] * _U(0x9E3779B97F4A7C15) + drawn[:, k] + _U(k))
    return keys


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sorted shingle sets."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    i = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    same = hb[i] == ha
    both = float(np.minimum(wa[same], wb[i[same]]).sum(dtype=np.float64))
    return both / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - both)


def signatures(texts: DataFrame, idf) -> DataFrame:
    """doc, weight and keys (of its bands) of the rows (doc, text) that have shingles. idf: a broadcast array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, bands = sample_tables(BANDS * ROWS), np.arange(BANDS, dtype=np.uint64)
        for batch in text_batches(batches, "text", BATCH_BYTES):
            words, first = text_words(batch.column(1))
            hashes, weights, at = shingles(words, first, idf.value)
            full = np.flatnonzero(np.diff(at))
            keys = mix64(band_keys(draws(hashes, weights, at, tables)[full], ROWS) + bands)
            docs = batch.column(0).to_numpy(zero_copy_only=False)[full]
            offsets = pa.array(np.arange(0, BANDS * len(full) + 1, BANDS, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(total_weights(weights, at)[full]), lists], ["doc", "weight", "keys"])

    return texts.select("doc", "text").mapInArrow(run, "doc long, weight double, keys array<long>")


def total_weights(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each text's sum of weights."""
    return np.array([weights[i:j].sum(dtype=np.float64) for i, j in zip(at[:-1], at[1:], strict=True)], np.float64)


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """pairs (a, b) with sim, their texts' weighted Jaccard similarity. A text a is sent once for each part of its b's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in text_batches(batches, "text", BATCH_BYTES):
            words, first = text_words(batch.column(3))
            hashes, weights, at = shingles(words, first, idf.value)
            heads, sims = batch.column(2).is_null().to_pylist(), []
            for i, head in enumerate(heads):
                own = hashes[at[i] : at[i + 1]], weights[at[i] : at[i + 1]]
                if head:
                    kept = own
                sims.append(None if head else similarity(kept, own))
            sims = pa.array(sims, pa.float64())
            done = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sims], ["a", "b", "sim"])
            yield done.filter(sims.is_valid())

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.hash("b"), "parts").alias("part"), "b")
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    rows = heads.join(texts.withColumnRenamed("doc", "a"), "a").select("a", "part", "b", "text")
    rows = rows.unionByName(dealt.join(texts.withColumnRenamed("doc", "b"), "b").select("a", "part", "b", "text"))
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "b").mapInArrow(run, "a long, b long, sim double")


def shingle_rows(texts: DataFrame, idf) -> DataFrame:
    """doc, weight (of the text), shingle, w (its weight) of the rows (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", BATCH_BYTES):
            words, first = text_words(batch.column(1))
            hashes, weights, at = shingles(words, first, idf.value)
            n, docs = np.diff(at), batch.column(0).to_numpy(zero_copy_only=False)
            columns = np.repeat(docs, n), np.repeat(total_weights(weights, at), n), hashes.view(np.int64), weights.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "weight", "shingle", "w"])

    return texts.select("doc", "text").mapInArrow(run, "doc long, weight double, shingle long, w double")


def prefix_entries(labels: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """shingle, doc, weight, most: the shingles that a doc of labels (doc, ...) may share first with a similar one.

    Texts of weights x and y have the similarity s only if they share s / (1 + s) (x + y) or more. What follows
    the first shingle they share bounds what they share, on either side; most is the weight of the heaviest
    text that the one side still could be similar to.
    """
    share = threshold / (1 + threshold)
    rows = stored(shingle_rows(texts.join(labels, "doc", "left_semi"), idf))
    common = rows.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    # from the end of the order on; shingles that no other text has would come first of all
    back = Window.partitionBy("doc").orderBy(F.desc("n"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    follows = F.sum("w").over(back) * (1 + 1e-9)
    prefix = rows.join(common, "shingle").withColumn("most", follows / share - F.col("weight"))
    return stored(prefix.filter(F.col("most") >= threshold * F.col("weight") * (1 - 1e-9)).select("shingle", "doc", "weight", "most"))


def shared_lists(prefix: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of the shingles that docs of several labels share, with their label, main (the largest of
    the shingle's labels), its entry that could be similar to the heaviest text, and the list's parts."""
    entries = prefix.join(labels, "doc")
    best = F.max_by(F.struct("doc", "weight", "most"), F.struct("most", "doc"))
    by_label = entries.groupBy("shingle", "label").agg(F.count("*").alias("n"), F.min("weight").alias("least"), best.alias("best"))
    largest = F.max_by(F.struct("label", "best"), F.struct("n", "label"))
    lists = by_label.groupBy("shingle").agg(largest.alias("main"), F.min("least").alias("least"), F.sum("n").alias("n"), F.count("*").alias("labels")).filter("labels > 1")
    lists = lists.select("shingle", F.col("main.label").alias("main"), F.col("main.best").alias("best"), "least", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    return stored(entries.join(lists, "shingle").filter("most >= least").drop("least"))


_NEAR = "label_x <> label AND weight <= most_x AND weight_x <= most"


def star_pairs(entries: DataFrame) -> DataFrame:
    """a, b: each entry of shared_lists() outside its list's main label with that label's best entry."""
    found = entries.withColumns({"label_x": F.col("main"), "doc_x": F.col("best.doc"), "weight_x": F.col("best.weight"), "most_x": F.col("best.most")})
    return ordered_pairs(found.filter(_NEAR))


def list_pairs(entries: DataFrame) -> DataFrame:
    """a, b: all pairs of entries of one list that differ in their label and may be of the threshold's similarity."""
    few = entries.filter("label <> main").select("shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"{c}_x") for c in ("doc", "label", "weight", "most")))
    every = entries.withColumn("part", F.pmod(F.hash("doc"), "parts")).select("shingle", "part", "doc", "label", "weight", "most")
    return ordered_pairs(few.join(every, ["shingle", "part"]).filter(_NEAR))


def ordered_pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("doc", "doc_x").alias("a"), F.greatest("doc", "doc_x").alias("b")).distinct()


def prefix_pairs(labels: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """All pairs (a, b) of docs of labels (doc, label) that differ in their label and may be of the threshold's similarity."""
    return list_pairs(shared_lists(prefix_entries(labels, texts, idf, threshold), labels))


def similar_classes(keys: DataFrame, texts: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """doc, class_id of all documents linked to another, and of some that are not; keys: doc, weight, key (a row
    a band); texts: doc, text."""
    leads = keys.groupBy("key").agg(F.min_by("doc", F.struct("weight", "doc")).alias("lead"), F.count("*").alias("n")).filter("n > 1")
    seats = stored(keys.join(leads.drop("n"), "key").filter("doc <> lead").select("key", "lead", "doc"))
    pairs = stored(seats.select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    # asked grows with the corpus: the join's plan is the one for large tables at every size
    texts = stored(texts.join(asked.hint("merge"), "doc", "left_semi").dropDuplicates(["doc"]))
    linked = lambda pairs: stored(verified(pairs, texts, idf).filter(F.col("sim") >= threshold).select("a", "b"))
    classes = stored(components(linked(pairs)))
    labelled = seats.join(classes, "doc", "left").select("key", "doc", F.coalesce("class_id", "doc").alias("label"))
    contested = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    labels = stored(labelled.join(contested, "key", "left_semi").select("doc", "label").distinct())
    if labels.isEmpty():
        return classes
    classes = classes.unionByName(labels.join(classes, "doc", "left_anti").select("doc", F.col("doc").alias("class_id")))
    prefix = prefix_entries(labels, texts, idf, threshold)
    # large classes that only their leaders kept apart are joined by few pairs first, so all pairs are fewer
    for pairs_of in (star_pairs, list_pairs):
        links = linked(stored(pairs_of(shared_lists(prefix, labels))))
        label = lambda c, labels=labels: labels.select(F.col("doc").alias(c), F.col("label").alias(f"{c}_label"))
        joined = stored(components(links.join(label("a"), "a").join(label("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))))
        end = lambda c, joined=joined: joined.select(F.col("doc").alias(c), F.col("class_id").alias("end"))
        classes = classes.join(end("class_id"), "class_id", "left").select("doc", F.coalesce("end", "class_id").alias("class_id"))
        labels = stored(labels.join(end("label"), "label", "left").select("doc", F.coalesce("end", "label").alias("label")))
    return classes


def components(links: DataFrame) -> DataFrame:
    """doc, class_id (the smallest doc of its component) of all linked docs.

    Each level hooks every doc to its smallest neighbour, if that is smaller, shortens these ways twice,
    and goes on with the links between the docs that they end at; a level later than the first has at most
    half of the docs, mostly far fewer.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if edges.isEmpty():
        return edges.toDF("doc", "class_id")
    ends, levels = edges.select(F.col("v").alias("doc")), []
    while not levels or not edges.isEmpty():
        hook = edges.groupBy("u").agg(F.min("v").alias("p"))
        for _ in range(2):
            hook = hook.join(hook.select(F.col("u").alias("p"), F.col("p").alias("q")), "p", "left").select("u", F.coalesce("q", "p").alias("p"))
        hook = stored(hook)
        levels.append(hook)
        end = lambda c, hook=hook: hook.select(F.col("u").alias(c), F.col("p").alias(f"{c}_end"))
        over = edges.join(end("u"), "u").join(end("v"), "v", "left").select(F.col("u_end").alias("a"), F.coalesce("v_end", "v").alias("b"))
        further = hook.select(F.col("p").alias("u")).distinct().join(end("u"), "u").select(F.col("u").alias("a"), F.col("u_end").alias("b"))
        edges = stored(over.unionByName(further).filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    # those without a smaller neighbour; not all of them end a way
    lows = ends.distinct().join(levels[0].select(F.col("u").alias("doc")), "doc", "left_anti")
    out = levels[0].select(F.col("u").alias("doc"), F.col("p").alias("class_id")).unionByName(lows.withColumn("class_id", F.col("doc")))
    for hook in levels[1:]:
        out = out.join(hook.select(F.col("u").alias("class_id"), F.col("p").alias("end")), "class_id", "left").select("doc", F.coalesce("end", "class_id").alias("class_id"))
    return out


def doc_key() -> Column:
    """Tells documents apart; rows of equal doc_ids and texts have one key."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(NULL_ID)), F.coalesce("text", F.lit("")), F.col("text").isNull())


def document_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc (the key), id, sha (of the text, NULL for none), least (the id and doc that are smallest in its class) for each row of docs."""
    spark = docs.sparkSession
    keyed = docs.select(doc_key().alias("doc"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text")
    slim = stored(keyed.select("doc", "id", F.unhex(F.md5("text")).alias("sha")))
    equal = slim.filter("sha is not null").groupBy("sha").agg(F.min("doc").alias("rep"), F.count("*").alias("n"))
    copies = stored(slim.join(equal.filter("n > 1").select("sha", "rep"), "sha").filter("doc <> rep").select("doc", "rep").distinct())
    frequencies, n = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(word_weights(frequencies, n))
    texts = keyed.filter("text is not null").select("doc", "text")
    marks = stored(signatures(texts, idf).join(copies, "doc", "left_anti").dropDuplicates(["doc"]))
    linked = stored(similar_classes(marks.select("doc", "weight", F.explode("keys").alias("key")), texts, idf, threshold))
    ends = copies.join(linked.withColumnRenamed("doc", "rep"), "rep", "left").select("doc", "rep", F.coalesce("class_id", "rep").alias("class_id"))
    heads = ends.select(F.col("rep").alias("doc"), "class_id").distinct()
    classes = stored(linked.unionByName(ends.select("doc", "class_id")).unionByName(heads).distinct())
    place = F.struct("id", "doc")
    least = classes.join(slim, "doc").groupBy("class_id").agg(F.min(place).alias("least"))
    named = classes.join(least, "class_id").select("doc", "least")
    return slim.join(named, "doc", "left").withColumn("least", F.coalesce("least", place))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) for each row of docs (doc_id, text)."""
    null = F.lit(NULL_ID)
    return document_classes(docs, threshold).select(F.nullif("id", null).alias("doc_id"), F.nullif("least.id", null).alias("class_id"))


@set_aside("near_")
def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs of which each class keeps one row of its smallest doc_id; null texts all stay."""
    found = stored(document_classes(docs, threshold).filter("sha is not null").select(F.col("doc").alias("near_doc"), (F.col("doc") != F.col("least.doc")).alias("gone")))
    found = found.groupBy("near_doc").agg(F.max("gone").alias("gone"), F.count("*").alias("n"))
    keyed = docs.withColumn("near_doc", doc_key())
    single = keyed.join(found.filter("gone or n > 1"), "near_doc", "left_anti")
    twice = keyed.join(found.filter("not gone and n > 1"), "near_doc", "left_semi").dropDuplicates(["near_doc"])
    return single.unionByName(twice).drop("near_doc")
