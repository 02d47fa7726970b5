"""Removing repeated passages: a de Bruijn graph over words, compacted along document coordinates.

Edges of the graph are k consecutive words (windows). An edge repeats if a document with a smaller id
holds it too; the words under repeated edges go. Neighbouring edges share their smallest 5-gram hash (their
minimizer), so they are kept together as one stretch and sent to the bucket of that minimizer; equal edges
meet in the same bucket. There repeated edges with neighbouring coordinates in both documents compact into
one piece. Pieces compact into nonbranching paths by joins: a path begins at a piece that no piece goes on
to in both documents, and ends at one that none goes on from, which is where the graph branches for the two;
the nth beginning belongs to the nth end on the same diagonal of the two documents' coordinates.
Paths are joined to their documents and to their sources by doc_id and a hash of the text, the words at both
coordinates are compared by digest, and the verified paths are cut from the text. The windows of a path that
fails are sought again in all documents by digests of their words, so a hash that two windows share neither
removes nor saves anything.

Scale: one shuffle of HASH_BYTES a window, few of the pieces and paths, one of the texts, and of
the paths' coordinates and digests. Within a batch of texts only the smallest document of each edge
is sent, so a passage in a third of all documents reaches its bucket once a batch. Buckets are as many as
the texts have MB, at least twice the shuffle partitions.

Defined cases: a null text has no words; a null doc_id is above all others; texts under k words lose
nothing; equal doc_ids, and so null ones, are not smaller than each other; rows that repeat a doc_id have
removals of their own unless their texts are equal too; an empty table gives an empty result; other columns
stay, but for those named like the new ones, which these replace.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import NULL_ID, gram_hashes, mix64, runs, set_aside, shuffle_partitions, spread, stored, text_batches, text_bytes, word_bounds, word_hashes

WINDOW, GRAM = 13, 5
BATCH_BYTES = 6 << 20
#: A task hands on about so many bytes at once, and cuts about so many bytes of texts at once.
OUT_BYTES, CUT_BYTES = 1 << 20, 1 << 20
#: All of a window's hash is sent; the digests that follow decide.
HASH_BYTES = 8
MOST_BUCKETS = 1 << 30
_PIECES = "sub_doc long, sub_row long, sub_start int, sub_n int, sub_source long, sub_from long, sub_at int"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    have, y = 1, x
    while have * 2 <= w:
        y = np.minimum(y[:-have], y[have:])
        have *= 2
    return np.minimum(y[: len(x) - w + 1], y[w - have : len(x) - have + 1]) if have < w else y


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, differences of the first, compressed."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(first)) + b"".join(a.tobytes() for a in (first, *arrays[1:])))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = struct.unpack_from("<q", data)[0], 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return [np.cumsum(out[0]), *out[1:]]


def windows(texts: pa.Array, k: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the texts: its hash, its minimizer, its text's number, its first word's number."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_bounds(data, offsets)
    counts = np.maximum(np.diff(first) - k + 1, 0)
    words = word_hashes(data, starts, ends)
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    del starts, ends
    at = spread(first[:-1], counts)
    lows = sliding_min(gram_hashes(words, gram, seed=7), k - gram + 1)[at]
    hashes = gram_hashes(words, k)[at]
    del words
    at -= np.repeat(first[:-1], counts)
    return hashes, lows, np.repeat(np.arange(len(counts), dtype=np.int32), counts), at.astype(np.int32)


def held_before(hashes: np.ndarray, text: np.ndarray, pos: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """The windows that a smaller document holds too, in their order; the smallest such document, its row (of equal
    doc_ids the smallest) and where the window first starts there. ids and keys: doc_id and row of each text."""
    order = np.argsort(hashes, kind="stable")
    # most windows are alone; only the others are looked at
    same = hashes[order[1:]] == hashes[order[:-1]]
    shared = np.zeros(len(order), bool)
    shared[1:] = same
    shared[:-1] |= same
    heads = np.ones(len(order), bool)
    heads[1:] = ~same
    order, heads = order[shared], np.flatnonzero(heads[shared])
    if not len(order):
        return [order, order, order, pos[:0]]
    sizes = np.diff(np.append(heads, len(order)))
    of = text[order]
    least, lows = np.ones(len(order), bool), []
    for x in (ids[of], keys[of], pos[order]):
        lows.append(np.repeat(np.minimum.reduceat(np.where(least, x, np.iinfo(x.dtype).max), heads), sizes))
        least &= x == lows[-1]
    again = np.flatnonzero(lows[0] < ids[of])
    again = again[np.argsort(order[again], kind="stable")]
    return [order[again], *(x[again] for x in lows)]


def pieces(docs: np.ndarray, rows: np.ndarray, pos: np.ndarray, holder: np.ndarray, held: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
    """Repeated windows in the order of their texts, compacted where both coordinates go on by one."""
    if not len(docs):
        return [docs, rows, pos, pos, holder, held, where]
    cut = (docs[1:] != docs[:-1]) | (rows[1:] != rows[:-1]) | (pos[1:] != pos[:-1] + 1) | (holder[1:] != holder[:-1]) | (held[1:] != held[:-1]) | (where[1:] != where[:-1] + 1)
    heads = np.flatnonzero(np.concatenate(([True], cut)))
    n = np.diff(np.append(heads, len(docs))).astype(np.int32)
    return [docs[heads], rows[heads], pos[heads], n, holder[heads], held[heads], where[heads]]


def _sent(buckets: int, k: int, gram: int, width: int, batch: pa.RecordBatch) -> Iterator[tuple[int, bool, bytes]]:
    """For one batch: the pieces found in it, and by bucket the stretches of windows whose holder may be elsewhere."""
    ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    hashes, lows, text, pos = windows(batch.column(2), k, gram)
    if not len(hashes):
        return
    hashes &= np.uint64(2 ** (8 * width) - 1)
    again, *holders = held_before(hashes, text, pos, ids, keys)
    if len(again):
        of = text[again]
        yield int(ids[of[0]] % buckets), True, pack(*pieces(ids[of], keys[of], pos[again], *holders))
    bucket = (mix64(lows) % np.uint64(buckets)).astype(np.int32)
    del lows, holders
    keep = np.ones(len(hashes), bool)
    keep[again] = False
    sent = np.flatnonzero(keep)
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    bucket = bucket[sent]
    cut = (bucket[1:] != bucket[:-1]) | (sent[1:] != sent[:-1] + 1) | (text[sent[1:]] != text[sent[:-1]])
    heads = np.flatnonzero(np.concatenate(([True], cut)))
    lengths = np.diff(np.append(heads, len(sent))).astype(np.int32)
    parts = np.append(runs(bucket), len(sent))
    at = np.searchsorted(heads, parts)
    for i in range(len(parts) - 1):
        h = sent[heads[at[i] : at[i + 1]]]
        of = text[h]
        meta = pack(ids[of], keys[of], pos[h], lengths[at[i] : at[i + 1]])
        raw = hashes[sent[parts[i] : parts[i + 1]]].view(np.uint8).reshape(-1, 8)[:, :width]
        yield int(bucket[parts[i]]), False, struct.pack("<q", len(meta)) + meta + raw.tobytes()


def _edges(buckets: int, k: int, gram: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sub_bucket", "sub_found", "sub_blob"]
        for batch in text_batches(batches, "text", BATCH_BYTES):
            held, size = [], 0
            for row in _sent(buckets, k, gram, width, batch):
                if held and size + len(row[2]) > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _SENT, strict=True)], names)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _SENT, strict=True)], names)

    return run


_SENT = (pa.int32(), pa.bool_(), pa.binary())


def _repeats(width: int):
    """One bucket: passes found pieces on, and finds the windows that repeat between batches."""

    def run(table: pa.Table) -> pa.Table:
        done, stretches, raws = [], [], []
        for found, blob in zip(table.column("sub_found").to_pylist(), table.column("sub_blob"), strict=True):
            blob = blob.as_buffer()
            if found:
                done.append(unpack(blob, "<i8", "<i8", "<i4", "<i4", "<i8", "<i8", "<i4"))
            else:
                size = struct.unpack_from("<q", blob)[0]
                stretches.append(unpack(blob[8 : 8 + size], "<i8", "<i8", "<i4", "<i4"))
                raws.append(np.frombuffer(blob, np.uint8, offset=8 + size).reshape(-1, width))
        if raws:
            docs, rows, pos, lengths = (np.concatenate(x) for x in zip(*stretches, strict=True))
            hashes = np.zeros((int(lengths.sum()), 8), np.uint8)
            at = 0
            for raw in raws:
                hashes[at : at + len(raw), :width] = raw
                at += len(raw)
            text, pos = np.repeat(np.arange(len(docs), dtype=np.int32), lengths), spread(pos, lengths).astype(np.int32)
            again, *holders = held_before(hashes.view(np.uint64)[:, 0], text, pos, docs, rows)
            of = text[again]
            done.append(pieces(docs[of], rows[of], pos[again], *holders))
        columns = [np.concatenate(x) for x in zip(*done, strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["sub_doc", "sub_row", "sub_start", "sub_n", "sub_source", "sub_from", "sub_at"])

    return run


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with sub_doc, its doc_id or NULL_ID, and sub_row, which tells rows of one doc_id apart by their texts."""
    return docs.withColumns({"sub_doc": F.coalesce("doc_id", F.lit(NULL_ID)), "sub_row": F.xxhash64("text")})


def repeated_pieces(docs: DataFrame, k: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """sub_doc, sub_row, sub_start, sub_n: from word sub_start on, sub_n windows of the document also start, one
    word apart from sub_at on, in the document sub_source (its row sub_from), the smallest that holds them."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(2 * shuffle_partitions(docs.sparkSession), size >> 20))
    sent = row_keys(docs).select("sub_doc", "sub_row", "text").mapInArrow(_edges(buckets, k, gram, HASH_BYTES), "sub_bucket int, sub_found boolean, sub_blob binary")
    return sent.groupBy("sub_bucket").applyInArrow(_repeats(HASH_BYTES), _PIECES)


def compacted(pieces: DataFrame) -> DataFrame:
    """The nonbranching paths of pieces (rows of _PIECES), in the same form."""
    # one diagonal: what a document's words are moved by in the source
    keyed = pieces.withColumn("sub_diag", F.col("sub_at") - F.col("sub_start")).withColumn("sub_end", F.col("sub_start") + F.col("sub_n"))
    way = ["sub_doc", "sub_row", "sub_source", "sub_from", "sub_diag"]
    begins = keyed.join(keyed.select(*way, F.col("sub_end").alias("sub_start")), [*way, "sub_start"], "left_anti").select(*way, "sub_start")
    ends = keyed.join(keyed.select(*way, F.col("sub_start").alias("sub_end")), [*way, "sub_end"], "left_anti").select(*way, "sub_end")
    nth = lambda c: F.row_number().over(Window.partitionBy(*way).orderBy(c)).alias("sub_nth")
    paths = begins.select(*way, "sub_start", nth("sub_start")).join(ends.select(*way, "sub_end", nth("sub_end")), [*way, "sub_nth"])
    return paths.select("sub_doc", "sub_row", "sub_start", (F.col("sub_end") - F.col("sub_start")).alias("sub_n"), "sub_source", "sub_from", (F.col("sub_start") + F.col("sub_diag")).alias("sub_at"))


def repeated_paths(docs: DataFrame, k: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """sub_doc, sub_row, sub_paths: the repeated paths of each document that has any."""
    paths = compacted(stored(repeated_pieces(docs, k, gram).distinct()))
    path = F.struct(F.col("sub_start").alias("start"), F.col("sub_n").alias("n"), F.col("sub_source").alias("source"), F.col("sub_from").alias("from"), F.col("sub_at").alias("at"))
    return paths.groupBy("sub_doc", "sub_row").agg(F.sort_array(F.collect_list(path)).alias("sub_paths"))


_OWN = "array<struct<start:int,n:int,source:long,from:long,at:int,words:binary>>"
_SERVED = "array<struct<at:int,n:int,words:binary>>"


def _cut(k: int, keep_text: bool):
    """Cuts the paths' words out; gives the digests of the paths' words, and of those that others' paths start from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", CUT_BYTES):
            text, paths, asked = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "sub_paths", "sub_asked"))
            n_words, n_removed, sha, kept_text, own, served = [], [], [], [], [], []
            for t, held, wanted in zip(text, paths, asked, strict=True):
                words = t.encode().split() if t else []
                digest = lambda a, n, words=words: hashlib.md5(b" ".join(words[a : a + n + k - 1])).digest()
                n_words.append(len(words))
                own.append([p | {"words": digest(p["start"], p["n"])} for p in held or ()])
                served.append([p | {"words": digest(p["at"], p["n"])} for p in wanted or ()])
                if held:
                    change = np.zeros(len(words) + 1, np.int32)
                    for p in held:
                        a, b = p["start"], p["start"] + p["n"] + k - 1
                        if b <= len(words):
                            change[a] += 1
                            change[b] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] <= 0)]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                sha.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    kept_text.append(kept.decode() if t is not None else None)
            columns = {f: batch.column(i) for i, f in enumerate(batch.schema.names) if f not in ("sub_paths", "sub_asked")}
            if keep_text:
                columns["text"] = pa.array(kept_text, pa.string())
            else:
                columns.pop("text")
            columns |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_paths": pa.array(map(len, own), pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            columns |= {"sub_own": pa.array(own, _OWN_ARROW), "sub_served": pa.array(served, _SERVED_ARROW)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


_OWN_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("source", pa.int64()), ("from", pa.int64()), ("at", pa.int32()), ("words", pa.binary())]))
_SERVED_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("words", pa.binary())]))


def _lost(k: int):
    """For each window of the rows' paths: where it starts, its hash and the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", BATCH_BYTES):
            text, paths = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            doc, start, digest, hashes = [], [], [], []
            for i, (t, held) in enumerate(zip(text, paths, strict=True)):
                words = t.encode().split()
                every = sorted({a for p in held for a in range(p["start"], p["start"] + p["n"]) if a + k <= len(words)})
                doc += [i] * len(every)
                start += every
                digest += [hashlib.md5(b" ".join(words[a : a + k])).digest() for a in every]
                hashes.append(windows(pa.array([t]), k, k)[0][every])
            found = np.concatenate(hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), pa.array(start, pa.int32()), pa.array(found), pa.array(digest, pa.binary())], ["sub_doc", "sub_row", "start", "hash", "words"])

    return run


def _holders(k: int, wanted):
    """Where windows of the wanted hashes first start in each text, by the digests of their words. wanted: a sorted broadcast array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", BATCH_BYTES):
            hashes, _, text, pos = windows(batch.column(2), k, k)
            place = np.minimum(np.searchsorted(wanted.value, hashes), len(wanted.value) - 1)
            first: dict[tuple[int, bytes], int] = {}
            last, words = -1, []
            for h in np.flatnonzero(wanted.value[place] == hashes):
                if text[h] != last:
                    last = int(text[h])
                    words = batch.column(2)[last].as_py().encode().split()
                first.setdefault((last, hashlib.md5(b" ".join(words[pos[h] : pos[h] + k])).digest()), int(pos[h]))
            doc = pa.array([i for i, _ in first], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), pa.array(first.values(), pa.int32()), pa.array([d for _, d in first], pa.binary())], ["source", "from", "at", "words"])

    return run


def sought(docs: DataFrame, failed: DataFrame, k: int) -> DataFrame:
    """sub_doc, sub_row, p: the windows of failed paths (sub_doc, sub_row, sub_paths) that a smaller document
    holds word by word. Only hashes that different windows share come here; theirs alone are collected."""
    spark, keyed = docs.sparkSession, row_keys(docs).select("sub_doc", "sub_row", "text")
    rows = keyed.join(failed, ["sub_doc", "sub_row"]).select("sub_doc", "sub_row", "text", "sub_paths")
    lost = stored(rows.mapInArrow(_lost(k), "sub_doc long, sub_row long, start int, hash long, words binary").distinct())
    hashes = np.array([r.hash for r in lost.select("hash").distinct().collect()], np.int64).view(np.uint64)
    wanted = spark.sparkContext.broadcast(np.sort(hashes))
    if not len(hashes):
        return lost.select("sub_doc", "sub_row", F.struct("start", F.lit(1).alias("n"), F.lit(0).cast("long").alias("source"), F.lit(0).cast("long").alias("from"), F.lit(0).alias("at")).alias("p"))
    least = keyed.mapInArrow(_holders(k, wanted), "source long, from long, at int, words binary").groupBy("words").agg(F.min(F.struct("source", "from", "at")).alias("low"))
    found = lost.join(least, "words").filter("low.source < sub_doc")
    return found.select("sub_doc", "sub_row", F.struct("start", F.lit(1).alias("n"), "low.source", "low.from", "low.at").alias("p"))


@set_aside("sub_", "n_words", "n_removed", "n_paths", "kept_sha256")
def remove_repeats(docs: DataFrame, k: int = WINDOW, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """docs without the words under repeated windows of k words, and n_words, n_removed, n_paths (the
    repeated paths) and kept_sha256. Kept words are joined by one space. Without keep_text, text is left out."""
    paths = stored(repeated_paths(docs, k, gram))
    keyed = row_keys(docs)
    fields = [f for f in keyed.schema.fields if keep_text or f.name != "text"]
    new = [T.StructField(n, T.LongType()) for n in ("n_words", "n_removed", "n_paths")] + [T.StructField("kept_sha256", T.StringType())]
    ddl = T.StructType(fields + new).add("sub_own", T.DataType.fromDDL(_OWN)).add("sub_served", T.DataType.fromDDL(_SERVED))
    row, place = ["sub_doc", "sub_row"], ["source", "from", "at", "n", "words"]
    while True:
        each = paths.select(F.explode("sub_paths").alias("p"))
        asked = each.select(F.col("p.source").alias("sub_doc"), F.col("p.from").alias("sub_row"), "p.at", "p.n").distinct().groupBy(row).agg(F.collect_list(F.struct("at", "n")).alias("sub_asked"))
        joined = keyed.join(paths, row, "left").join(asked, row, "left").select(*keyed.columns, "sub_paths", "sub_asked")
        out = stored(joined.mapInArrow(_cut(k, keep_text), ddl))
        # the words at the source's coordinates must be the path's own; the windows of a path that fails are sought again
        mine = out.select(*row, F.explode("sub_own").alias("p")).select(*row, "p.*")
        theirs = out.select(F.col("sub_doc").alias("source"), F.col("sub_row").alias("from"), F.explode("sub_served").alias("p")).select("source", "from", "p.at", "p.n", "p.words")
        wrong = stored(mine.select(place).distinct().join(theirs, place, "left_anti"))
        if wrong.isEmpty():
            return out.drop(*row, "sub_own", "sub_served")
        path = F.struct("start", "n", "source", "from", "at")
        failed = mine.join(wrong, place, "left_semi").groupBy(row).agg(F.collect_set(path).alias("sub_paths"))
        good = mine.join(wrong, place, "left_anti").select(*row, path.alias("p"))
        again = good.unionByName(sought(docs, failed, k))
        paths = stored(again.groupBy(row).agg(F.collect_set("p").alias("sub_paths")))
