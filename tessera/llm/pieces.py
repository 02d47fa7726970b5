"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are split into units (white space marks and the word after them; no piece goes on over a
word's end), and the batch's different units are joined to one text. Its suffix array, sorted up to the
longest piece, is searched for every piece of the vocabulary; the occurrences are the edges, sorted by
position. Relaxing follows the model's kind, byte-pair merges: in every stretch that no edge leaves the best
edge that spans two neighbouring symbols (highest score, then leftmost) replaces them, until none does. What no piece covers
becomes byte pieces.

Scale: rows stand alone, no shuffle; a task holds one batch of bounded bytes and the vocabulary. Units are
matched once a batch, so common words cost once. Defined cases: null text gives null ids, empty text
none; the model's own white-space mark in a text decodes to a space, as the format has it; unpaired
surrogates can't occur in Spark strings; other columns stay, but for those named like the new ones, which
these replace. load() refuses models that break what is assumed here: a byte-pair model that changes texts
only by marking spaces, without pieces of LONGEST characters or pieces that go on over a word's end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import spread, text_batches, without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BATCH_BYTES = 6 << 20
#: So many characters of different units have one suffix array.
INDEX_CHARS = 1 << 20
#: A piece's length is packed with its position: load() refuses pieces of so many characters.
LONGEST = 32
#: Stretches of more characters are merged by a heap, the others side by side.
LONG = 256
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@dataclass
class Pieces:
    """The vocabulary: pieces that take part in matching, by id, with scores; byte pieces; what ids spell."""

    ids: np.ndarray
    texts: list[str]
    rank: np.ndarray  # by id: place in the order of scores, equal scores alike; smaller merges first
    single: dict[int, int]  # code point -> id
    byte: np.ndarray  # byte -> id
    spell: list[bytes]
    longest: int
    unknown: int
    points: np.ndarray  # the pieces' code points, end to end
    sizes: np.ndarray


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a serialized message's fields: whole numbers, or the bytes of other kinds."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def check_model(data: bytes) -> None:
    """Raises ValueError for a model that this encoder would read wrongly: no byte-pair model, or one that
    changes texts other than by marking spaces. Fixed values: the numbers of the public format's fields."""
    trainer = normalizer = b""
    for field, value in message_fields(data):
        if field == 2:
            trainer = value
        elif field == 3:
            normalizer = value
    if dict(message_fields(trainer)).get(3, 1) != 2:
        raise ValueError("the model is no byte-pair model")
    rules = dict(message_fields(normalizer))
    if rules.get(2) or rules.get(3, 1) != 1 or rules.get(4, 1) != 0 or rules.get(5, 1) != 1:
        raise ValueError("the model normalizes texts")


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    with open(path, "rb") as f:
        check_model(f.read())
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    texts = [model.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = np.array([model.get_score(i) for i in range(n)])
    _, rank = np.unique(-scores, return_inverse=True)
    byte = np.full(256, model.unk_id())
    for i in range(n):
        if model.is_byte(i):
            byte[int(texts[i][3:5], 16)] = i
    spell = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else t.replace(MARK, " ").encode() for i, t in enumerate(texts)]
    kept = [texts[i] for i in plain]
    if max(map(len, kept)) >= LONGEST:
        raise ValueError(f"a piece has {LONGEST} characters or more")
    if any(MARK in t.lstrip(MARK) for t in kept):
        raise ValueError("a piece goes on over a word's end")
    points = np.frombuffer("".join(kept).encode("utf-32-le"), np.uint32)
    return Pieces(np.array(plain), kept, rank, {ord(t): i for i, t in zip(plain, kept, strict=True) if len(t) == 1}, byte, spell, max(map(len, kept)), model.unk_id(), points, np.array([len(t) for t in kept]))


def ordered(key: np.ndarray, top: int) -> np.ndarray:
    """Positions that sort key (0 to top): by one plain sort of key and place together where 63 bits hold them."""
    bits = max(1, (len(key) - 1).bit_length())
    if top >> (63 - bits):
        return np.argsort(key, kind="stable")
    return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by at least depth values from them on. Behind the end stands a value below all."""
    points = np.flatnonzero(np.bincount(x))
    place = np.zeros(int(points[-1]) + 1, np.int64)
    place[points] = np.arange(1, len(points) + 1)
    rank, span = place[x], 1
    while True:
        wide, second = int(rank.max()) + 1, np.zeros_like(rank)
        second[:-span] = rank[span:]
        key = rank * wide + second
        span *= 2
        if span * 2 <= depth and wide**4 < 2**62:  # two doublings in one sort
            third = np.zeros_like(key)
            third[:-span] = key[span:]
            key = key * wide**2 + third
            span *= 2
        order = ordered(key, int(key.max()))
        if span >= depth:
            return order
        line = key[order]
        rank[order] = np.cumsum(np.concatenate(([1], (line[1:] != line[:-1]).astype(np.int64))))


def edges(x: np.ndarray, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of pieces in x, sorted by position and length (position * LONGEST + length), and their ids.

    The pieces are matched in the suffix array one character after the other: the range of suffixes that
    start with a piece's first j characters is narrowed by binary search on the j+1st.
    """
    deep = vocabulary.longest
    order = suffix_array(x, deep)
    padded = np.concatenate([x.astype(np.int64), np.full(deep, -1, np.int64)])
    sizes, points = vocabulary.sizes, vocabulary.points.astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), len(x), np.int64)
    for j in range(deep):
        live = np.flatnonzero((sizes > j) & (lo < hi))
        if not len(live):
            break
        want = points[begin[live] + j]
        for side in (0, 1):
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                have = padded[order[np.minimum(mid, len(x) - 1)] + j]
                right = open_ & ((have < want) if side == 0 else (have <= want))
                b = np.where(open_ & ~right, mid, b)
                a = np.where(right, mid + 1, a)
            if side == 0:
                first = a
            else:
                lo[live], hi[live] = first, a
    found = np.maximum(hi - lo, 0)
    at = order[spread(lo, found)]
    key = ((at * LONGEST + np.repeat(sizes, found)) << 32) | np.repeat(vocabulary.ids, found)
    key.sort()
    return key >> 32, key & 0xFFFFFFFF


def segments(starts: np.ndarray, total: int, key: np.ndarray) -> np.ndarray:
    """Where stretches start that no piece goes across, units' starts among them: merges stay within."""
    size, at = key % LONGEST, key // LONGEST
    change = np.bincount(at[size > 1] + 1, minlength=total + 1) - np.bincount((at + size)[size > 1], minlength=total + 1)
    free = np.cumsum(change)[:total] == 0
    free[starts] = True
    return np.flatnonzero(free)


def relax_long(begin: int, end: int, key: np.ndarray, rank: np.ndarray) -> tuple[list[int], list[int]]:
    """The same merges for one long stretch, by a heap: a merge costs a logarithm of the stretch."""
    after, before, alive = list(range(1, end - begin + 1)), list(range(-1, end - begin - 1)), [True] * (end - begin)
    heap: list[tuple[int, int, int]] = []
    n = end - begin

    def offer(left: int) -> None:
        right = after[left]
        if right < n and after[right] - left < LONGEST:
            k = (begin + left) * LONGEST + after[right] - left
            i = int(np.searchsorted(key, k))
            if i < len(key) and key[i] == k:
                heappush(heap, (int(rank[i]), left, after[right]))

    for left in range(n - 1):
        offer(left)
    while heap:
        _, left, to = heappop(heap)
        right = after[left] if alive[left] else n
        if right >= n or after[right] != to:
            continue
        alive[right], after[left] = False, to
        if to < n:
            before[to] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    kept = [x for x in range(n) if alive[x]]
    return [begin + x for x in kept], [begin + after[x] for x in kept]


def relax(starts: np.ndarray, ends: np.ndarray, key: np.ndarray, ids: np.ndarray, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Merges within each unit (starts to ends): the positions where the final symbols begin and end."""
    total = int(ends[-1]) if len(ends) else 0
    heads = segments(starts, total, key)
    sizes = np.diff(np.append(heads, total))
    unit = np.repeat(np.arange(len(heads)), sizes)
    at = np.arange(total)
    to = at + 1
    worst = np.iinfo(np.int64).max
    rank = vocabulary.rank[ids] if len(ids) else ids
    wide = total + 1

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and place of the edge from a to b; worst where there is none."""
        k = a * LONGEST + (b - a)
        i = np.minimum(np.searchsorted(key, k), max(len(key) - 1, 0))
        hit = (b - a < LONGEST) & (key[i] == k) if len(key) else np.zeros(len(a), bool)
        return np.where(hit, rank[i] * wide + a, worst) if len(key) else np.full(len(a), worst)

    done: list[tuple[np.ndarray, np.ndarray]] = []
    for k in np.flatnonzero(sizes > LONG):
        a, b = relax_long(int(heads[k]), int(heads[k] + sizes[k]), key, rank)
        done.append((np.array(a), np.array(b)))
    short = np.repeat(sizes <= LONG, sizes)
    at, to, unit = at[short], to[short], unit[short]
    pair = np.full(len(at), worst)
    same = np.flatnonzero(unit[1:] == unit[:-1])
    pair[same] = score(at[same], to[same + 1])
    while len(at):
        heads = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        best = np.minimum.reduceat(pair, heads)
        sizes = np.diff(np.append(heads, len(at)))
        alive = np.repeat(best != worst, sizes)
        if not alive.all():
            done.append((at[~alive], to[~alive]))
            best = best[best != worst]
            at, to, unit, pair = at[alive], to[alive], unit[alive], pair[alive]
            if not len(at):
                break
            heads = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            sizes = np.diff(np.append(heads, len(at)))
        left = np.flatnonzero(pair == np.repeat(best, sizes))
        to[left] = to[left + 1]
        stay = np.ones(len(at), bool)
        stay[left + 1] = False
        moved = np.cumsum(stay) - 1
        at, to, unit, pair = at[stay], to[stay], unit[stay], pair[stay]
        left = moved[left]
        mark = np.zeros(len(at), bool)
        mark[left] = True
        mark[np.maximum(left - 1, 0)] = True
        touched = np.flatnonzero(mark)
        follows = touched[touched + 1 < len(at)]
        follows = follows[unit[follows] == unit[follows + 1]]
        pair[touched] = worst
        pair[follows] = score(at[follows], to[follows + 1])
    if not done:
        return at, to
    a, b = np.concatenate([x for x, _ in done]), np.concatenate([y for _, y in done])
    by = np.argsort(a, kind="stable")
    return a[by], b[by]


def encode_units(units: list[str], vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units end to end, and len+1 offsets; units are indexed INDEX_CHARS at a time."""
    ends = np.cumsum(np.array([len(u) for u in units], np.int64))
    parts, at = [], 0
    while at < len(units):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + INDEX_CHARS, side="right")))
        parts.append(encode_part(units[at:to], vocabulary))
        at = to
    flat = np.concatenate([np.zeros(0, np.int32), *(f for f, _ in parts)])
    return flat, np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)]))])


def encode_part(units: list[str], vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units end to end, and how many each has."""
    joined = "".join(units)
    x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.array([len(u) for u in units]))
    starts = ends - np.diff(ends, prepend=0)
    key, ids = edges(x, vocabulary)
    a, b = relax(starts, ends, key, ids, vocabulary)
    if len(key):
        i = np.minimum(np.searchsorted(key, a * LONGEST + (b - a)), len(key) - 1)
        known = key[i] == a * LONGEST + (b - a)
        out = np.where(known, ids[i], -1)
    else:
        out = np.full(len(a), -1)
    unit = np.searchsorted(ends, a, side="right")
    lengths = np.ones(len(a), np.int64)
    missing = np.flatnonzero(out < 0)  # single characters without a piece: their bytes
    spelled = [[int(vocabulary.byte[c]) for c in chr(x[a[m]]).encode("utf-8", "surrogatepass")] for m in missing]
    lengths[missing] = [len(s) for s in spelled]
    flat = np.repeat(out, lengths).astype(np.int32)
    if len(missing):
        where = (np.cumsum(lengths) - lengths)[missing]
        flat[spread(where, lengths[missing])] = np.concatenate([np.array(s, np.int32) for s in spelled])
    per_unit = np.bincount(unit, weights=lengths, minlength=len(units)).astype(np.int64)
    return flat, per_unit


def encode_batch(texts: list[str | None], vocabulary: Pieces) -> list[np.ndarray | None]:
    """Ids of each text; null: None."""
    split = [_UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    sizes = np.array([len(u) for u in split], np.int64)
    every = list(chain.from_iterable(split))
    units = list(dict.fromkeys(every))
    number = dict(zip(units, range(len(units)), strict=True))
    places = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
    del split, every, number
    flat, offsets = encode_units(units, vocabulary)
    lengths = np.diff(offsets)[places]
    found = flat[spread(offsets[places], lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
    return [None if t is None else ids for t, ids in zip(texts, np.split(found, ends[:-1]), strict=True)]


def decode_ids(ids: np.ndarray, vocabulary: Pieces) -> str:
    """The text the ids spell: pieces and bytes joined; the space set before the text is dropped; bytes
    that are no UTF-8 become replacement characters."""
    spell = vocabulary.spell
    data = b"".join([spell[i] for i in ids.tolist()])
    return data[data[:1] == b" " :].decode("utf-8", "replace")


def _run(path: str, keep_ids: bool, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in text_batches(batches, "text", BATCH_BYTES):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = encode_batch(texts, vocabulary)
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if keep_ids or n != "text"}
            columns["n_tokens"] = pa.array([None if x is None else len(x) for x in found], pa.int64())
            if keep_ids:
                columns["ids"] = pa.array(found, pa.list_(pa.int32()))
            if digests:
                back = [None if x is None else decode_ids(x, vocabulary) for x in found]
                columns["ids_sha256"] = pa.array([None if x is None else hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in found], pa.string())
                columns["decoded_sha256"] = pa.array([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string())
                columns["round_trip"] = pa.array([None if b is None else b == t.replace(MARK, " ") for b, t in zip(back, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def encode(docs: DataFrame, path: str = MODEL, keep: bool = True, digests: bool = False) -> DataFrame:
    """docs with n_tokens and, if kept, ids; with digests also the ids' and the decoded text's SHA-256 and
    whether decoding gives the text again. Without keep, text and ids are left out."""
    docs = without(docs, "n_tokens", *["ids"] * keep, *["ids_sha256", "decoded_sha256", "round_trip"] * digests)
    fields = [f for f in docs.schema.fields if keep or f.name != "text"]
    schema = T.StructType(fields).add("n_tokens", "long")
    if keep:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    if digests:
        schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string").add("round_trip", "boolean")
    return docs.mapInArrow(_run(path, keep, digests), schema)


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """rows (with ids) and decoded, the text the ids spell; null ids: null."""
    rows = without(rows, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            back = [None if x is None else decode_ids(np.array(x, np.int64), vocabulary) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
