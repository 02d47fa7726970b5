"""Language identification with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1. A trigram's vector binds, by
product, its letters' vectors permuted by their place; a text's vector bundles, by sum, those of all its
trigrams; a language's prototype bundles its labelled texts. A text gets the language whose prototype
has the largest cosine with it.

Scale: no shuffle but the prototypes' partial sums (a vector per task and language). Texts are counted in
blocks of trigrams and projected by matrix products. All teaching rows are learned from, unless fit is
asked for a sample, and the bounds of scores come from all of them: counts by size and step of score.

Defined cases: null text or text without a letter is `und` with score 0; rows with null lang or null
doc_id don't teach; without any teaching row every text is `und`; ties go to the first language by code
point; very long texts are taken whole, block by block; equal texts get equal results; other columns stay, but
for lang_pred and score, which the new ones replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import mix64, text_batches

DIMS = 1024
#: Of each language at least about this many rows are kept by a sample, if one is asked for, or all it has.
LEAST = 100
#: Scores are counted by so many steps from 0 to 1.
STEPS = 10_000
UNKNOWN = "und"
#: Texts are counted together up to so many bytes.
BLOCK_BYTES, BATCH_BYTES = 1 << 20, 8 << 20
_U = np.uint64
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point: is it a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def letter_vectors(points: np.ndarray, dims: int) -> np.ndarray:
    """A row of +1 and -1 for each code point (0: the gap), a function of the code point alone."""
    cells = mix64(mix64(points.astype(np.uint64) + _U(1))[:, None] + np.arange(dims // 64, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    bits = np.unpackbits(cells.view(np.uint8).reshape(len(points), -1), axis=1)
    return (bits.astype(np.float32) * 2 - 1)[:, :dims]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the block; per trigram its three letters' places there (as one number), and its text."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) + 2 for p in points])
    flat = np.zeros(int(sizes.sum()), np.uint32)
    at = 0
    for p, n in zip(points, sizes, strict=True):
        flat[at + 1 : at + n - 1] = p
        at += n
    text = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    flat = np.where(letter_table()[flat], flat, 0)
    stay = np.ones(len(flat), bool)
    stay[1:] = (flat[1:] != 0) | (flat[:-1] != 0) | (text[1:] != text[:-1])
    flat, text = flat[stay], text[stay]
    seen = np.zeros(0x110000, bool)
    seen[flat] = True
    seen[0] = True
    letters = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[letters] = np.arange(len(letters))
    x = place[flat]
    n = len(letters)
    codes = (x[:-2] * n + x[1:-1]) * n + x[2:]
    inside = (text[:-2] == text[2:]) & (x[1:-1] != 0)
    return letters, codes[inside], text[:-2][inside]


def text_vectors(texts: list[str], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bundles, and how many trigrams (around a letter) each has."""
    out = np.zeros((len(texts), dims), np.float32)
    letters, codes, text = trigrams(texts)
    counts = np.bincount(text, minlength=len(texts))
    if not len(codes):
        return out, counts
    n = len(letters)
    if n**3 <= 1 << 24:
        seen = np.zeros(n**3, bool)
        seen[codes] = True
        kinds = np.flatnonzero(seen)
        place = np.zeros(n**3, np.int64)
        place[kinds] = np.arange(len(kinds))
        codes = place[codes]
    else:
        kinds, codes = np.unique(codes, return_inverse=True)
    base = letter_vectors(letters, dims)
    turned, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    for at in range(0, len(kinds), 4096):  # bounds the vectors of a block with very many trigrams
        part = kinds[at : at + 4096]
        chosen = (codes >= at) & (codes < at + len(part))
        table = np.bincount(text[chosen] * len(part) + codes[chosen] - at, minlength=len(texts) * len(part))
        vectors = twice[part // (n * n)]
        vectors *= turned[part // n % n]
        vectors *= base[part % n]
        out += table.reshape(len(texts), len(part)).astype(np.float32) @ vectors
    return out, counts


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about BLOCK_BYTES together and the place of the first."""
    at, held, size = 0, [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= BLOCK_BYTES or len(held) >= 512:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1, size)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def teaching(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """lang, text of the labelled rows that teach (fold other than 1); with sample, about so many of them at most."""
    known = docs.filter(docs.lang.isNotNull() & docs.text.isNotNull() & docs.doc_id.isNotNull() & (fold(docs.doc_id) != 1))
    if sample is None:
        return known.select("lang", "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    chosen = known
    if sum(counts.values()) > sample:
        share = max(sample / len(counts), LEAST)
        rates = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, share / n) * (1 << 30)))])
        chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rates[F.col("lang")])
    return chosen.select("lang", "text")


def fit(docs: DataFrame, sample: int | None = None, dims: int = DIMS) -> dict[str, np.ndarray]:
    """A prototype for each language among the labelled rows of docs that teach."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in text_batches(batches, "text", BATCH_BYTES):
            langs = batch.column(0).to_pylist()
            for at, texts in blocks(batch.column(1).to_pylist()):
                for lang, row in zip(langs[at:], unit(text_vectors(texts, dims)[0]), strict=False):
                    if lang in sums:
                        sums[lang] += row
                    else:
                        sums[lang] = row.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([np.rint(v * 2**20).astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    sums = teaching(docs, sample).mapInArrow(bundle, "lang string, v array<long>")
    total = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    total = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows = total.select("lang", F.col("v.x").alias("v")).collect()
    return {r.lang: np.array(r.v, np.float64) for r in sorted(rows, key=lambda r: r.lang)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dims: int = DIMS) -> DataFrame:
    """docs with lang_pred and score, the cosine with the best prototype, 0 if negative."""
    names = list(prototypes)
    table = unit(np.array([prototypes[n] for n in names])).astype(np.float32) if names else np.zeros((0, dims), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", BATCH_BYTES):
            found, scores = [], []
            for _, texts in blocks(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                vectors, counts = text_vectors(texts, dims)
                if not names:
                    found += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                cosines = unit(vectors) @ table.T
                best = cosines.argmax(axis=1)
                for b, row, n in zip(best, cosines, counts, strict=True):
                    found.append(names[b] if n else UNKNOWN)
                    scores.append(min(1.0, max(0.0, float(row[b]))) if n else 0.0)
            arrays = [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "lang_pred", "score"])

    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[f.name for f in fields]).mapInArrow(run, schema)


def size_class(text: Column) -> Column:
    """The binary logarithm of the text's number of letters, floored; NULL without a letter."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.floor(F.log2(letters.cast("double"))).cast("int"))


def score_bounds(docs: DataFrame, prototypes: dict[str, np.ndarray], share: float = 0.01, part: float = 0.5) -> dict[int, float]:
    """For each size class of texts, part of the score (rounded down to a step) that all but a share of the teaching
    rows of that size reach: what scores less resembles no language. Short texts score less, so every size has a
    bound of its own; sizes without teaching rows take that of the next smaller size that has some."""
    scored = predict(teaching(docs).select("text"), prototypes).filter(F.col("lang_pred") != UNKNOWN)
    steps = scored.select(size_class(F.col("text")).alias("size"), F.floor(F.col("score") * STEPS).alias("step")).filter("size is not null").groupBy("size", "step").count()
    of_size = Window.partitionBy("size")
    up = of_size.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = steps.select("size", "step", F.sum("count").over(up).alias("upto"), F.sum("count").over(of_size).alias("all"))
    low = reached.filter(F.col("upto") >= F.col("all") * share).groupBy("size").agg((F.min("step") / STEPS).alias("low"))
    known, bounds, last = {r["size"]: r.low * part for r in low.collect()}, {}, None
    for size in range(64):
        last = known.get(size, last)
        if last is not None:
            bounds[size] = last
    return bounds


def resembles(bounds: dict[int, float]) -> Column:
    """Does a predicted row (text, lang_pred, score) resemble the language found for it."""
    known = F.col("lang_pred") != UNKNOWN
    if not bounds:
        return known
    least = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[size_class(F.col("text"))]
    # letters are counted only where the score alone doesn't decide
    return known & ((F.col("score") >= max(bounds.values())) | (F.col("score") >= F.coalesce(least, F.lit(0.0))))
