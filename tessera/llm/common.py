"""Shared pieces: the scratch folder, clashing names, Arrow batches, numpy text kernels."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where ids are compared: above every real id.
NULL_ID = 2**63 - 1
#: Words everywhere in this package: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, as in tests, a local session
    gets one of its own; a cluster's executors would not see it, so there it has to be set."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def stored_tables() -> list[tuple[SparkSession, str]]:
    """The tables that stored() wrote and that still are there."""
    return list(_made)


def drop_stored(tables: list[tuple[SparkSession, str]] | None = None) -> None:
    """Deletes tables that stored() wrote (None: all); the results that read them are then gone."""
    for spark, path in stored_tables() if tables is None else tables:
        if (spark, path) not in _made:
            continue
        _made.remove((spark, path))
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - at exit the JVM may be gone already
            return


atexit.register(drop_stored)


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs without columns of these names: an operator's new columns replace those that are called the same."""
    return docs.drop(*[c for c in docs.columns if c.lower() in names])


def set_aside(prefix: str, *new: str) -> Callable:
    """For an operator (docs, ...): its new columns replace others of their names; columns whose names start
    like its inner ones are renamed while it works, so they come out as they went in."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            docs = without(docs, *new)
            held = {c: f"held_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower().startswith(prefix)}
            out = operator(docs.withColumnsRenamed(held), *args, **options)
            return out.withColumnsRenamed({v: k for k, v in held.items()})

        return run

    return wrap


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about limit bytes of the column; a longer value stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            room = offsets[at] + max(0, limit - size)
            to = max(at + 1 if not held else at, int(np.searchsorted(offsets, room, side="right")) - 1)
            to = min(to, batch.num_rows)
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(offsets[to] - offsets[at])
                at = to
            if at < batch.num_rows or size >= limit:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    table = pa.Table.from_batches(held).combine_chunks()
    return table.to_batches()[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, and len+1 offsets into them. Null: empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_BASE, _GRAM = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 (the public splitmix64 finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and the inverses, modulo 2**64; base is odd."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        ups = [np.full(size, b, np.uint64) for b in (base, _U(pow(int(base), -1, 2**64)))]
        for up in ups:
            up[0] = 1
            np.multiply.accumulate(up, out=up)
        have = _powers[int(base)] = (ups[0], ups[1])
    return have[0][:n], have[1][:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per text the index of its first word (len+1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of the words: a polynomial over scrambled bytes, scrambled again. Equal on every machine,
    whatever the block of bytes taken at once, which bounds the memory."""
    out = np.empty(len(starts), np.uint64)
    letters = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = powers(_BASE, hi - lo)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(letters[data[lo:hi]] * up, out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix64((sums[e] - sums[s]) * down[s])
        at = to
    return out


def gram_hashes(words: np.ndarray, k: int, seed: int = 0, block: int = 1 << 16) -> np.ndarray:
    """64-bit hashes of the k consecutive words from each position on; len(words)-k+1 values, block by block."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, block):
        to = min(at + block, n)
        part = words[at : to + k - 1]
        up, down = powers(_GRAM, len(part))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((part if not seed else mix64(part + _U(seed))) * up, out=sums[1:])
        out[at:to] = mix64((sums[k:] - sums[:-k]) * down[: to - at])
    return out


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s+l)."""
    total = int(lengths.sum())
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.arange(total) - first + np.repeat(starts, lengths)


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
