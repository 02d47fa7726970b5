"""Operators against versions written here from the definitions, and inputs made to be hard for them."""

import collections
import hashlib
import math
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, hamming, language, lines, mixing, neardup, pieces, png, queries, substrings, warc
from tessera.llm.common import stored, stored_tables
from tests.llm.test_small import WORDS, brute_repeats, exact_classes, frame, odd_rows, prose

SF = "/root/testdata/sf0.001"


def decoded_png(media):
    """Rows of a greyscale PNG, by the format's description."""
    assert media[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, data = 8, b""
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        assert struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            assert (depth, colour, rest) == (8, 0, [0, 0, 0])
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, rows, up = zlib.decompress(data), [], [0] * width
    for y in range(height):
        kind, line = raw[y * (width + 1)], raw[y * (width + 1) + 1 : (y + 1) * (width + 1)]
        row = []
        for x, v in enumerate(line):
            a, b, c = row[x - 1] if x else 0, up[x], up[x - 1] if x else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((v + [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        rows.append(row)
        up = row
    return rows


def low_waves(rows):
    """The 8 by 8 lowest cosine waves of the image, shrunk to 32 by 32 by area; the constant one counts as 0."""
    height, width = len(rows), len(rows[0])

    def shares(n):
        return [[max(0.0, min((i + 1) * n / 32, k + 1) - max(i * n / 32, k)) * 32 / n for k in range(n)] for i in range(32)]

    small = np.array(shares(height)) @ np.array(rows, float) @ np.array(shares(width)).T
    cosine = np.array([[math.cos(math.pi / 32 * (i + 0.5) * u) for i in range(32)] for u in range(8)])
    waves = cosine @ small @ cosine.T
    waves[0, 0] = 0
    return waves.ravel()


def test_png_by_the_format(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    shortest = sorted(texts, key=lambda i: len(texts[i]))[:60]
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("doc_id").isin(shortest))
    for r in png.decode(png.encode(docs)).collect():
        data = texts[r.doc_id].encode()
        whole = data + bytes(-len(data) % 64 or 64 * (not data))
        rows = decoded_png(r.media)
        assert b"".join(map(bytes, rows)) == whole and (r.n_bytes, r.payload_bytes) == (len(data), len(whole))
        assert (r.payload_sha256, r.tail_crc32, r.media_sha256) == (hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), hashlib.sha256(r.media).hexdigest())
        waves, bits = low_waves(rows), [int(b) for b in f"{int(r.feature, 16):064b}"]
        middle = sorted(waves)[31:33]
        for w, bit in zip(waves, bits, strict=True):
            if abs(w - sum(middle) / 2) > 1e-4:  # a wave at the median itself may round either way
                assert bit == (w > sum(middle) / 2)


def brute_profile(text):
    """The sum over the text's trigrams of the product of their letters' turned vectors."""
    letters = [c if c.isalpha() else "\0" for c in f"\0{text.lower()}\0"]
    line = [c for i, c in enumerate(letters) if c != "\0" or not i or letters[i - 1] != "\0"]
    grams = collections.Counter(zip(line, line[1:], line[2:]))
    total, n = np.zeros(language.DIMS), 0
    vector = {c: language.letter_vectors(np.array([ord(c)]), language.DIMS)[0] for c in set(line)}
    for (a, b, c), times in grams.items():
        if b != "\0":
            total += times * np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c]
            n += times
    return total, n


def test_language_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    docs += [(9001, "über " * 3000, None), (9002, None, "de"), (9003, "1 2 3", "en")]
    teach = collections.defaultdict(lambda: np.zeros(language.DIMS))
    profiles = {}
    for i, text, lang in docs:
        v, n = profiles[i] = brute_profile(text or "")
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 3 != 1 and n:
            teach[lang] += v / np.linalg.norm(v)
    names = sorted(teach)
    table = np.array([teach[x] / np.linalg.norm(teach[x]) for x in names])
    df = spark.createDataFrame([(i, t, x) for i, t, x in docs], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(df, language.fit(df)).collect()}
    assert len(got) == len(docs)
    for i, (v, n) in profiles.items():
        if not n:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosines = table @ v / np.linalg.norm(v)
        assert got[i].score == pytest.approx(max(0.0, cosines.max()), abs=1e-4)
        assert cosines[names.index(got[i].lang_pred)] > cosines.max() - 1e-4


def weighted_sets(texts):
    """Shingles of five words; a shingle weighs its count times the mean inverse document frequency of its words."""
    words = [WORDS.findall(t or "") for t in texts]
    seen = collections.Counter(w for ws in words for w in set(ws))
    idf = {w: 1 + math.log((1 + len(texts)) / (1 + n)) for w, n in seen.items()}
    out = []
    for ws in words:
        counts = collections.Counter(zip(*(ws[i:] for i in range(5)), strict=False))
        out.append({s: n * sum(idf[w] for w in s) / 5 for s, n in counts.items()})
    return out


def test_near_duplicates_recall(spark):
    """Every pair clearly above the threshold, found by an inverted index in plain Python, shares a class; no
    class holds documents that no chain of pairs near the threshold connects."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null").select("doc_id", "text").collect()
    texts = sorted({r.text for r in docs})
    sets = weighted_sets([r.text for r in docs])
    sets = {r.text: s for r, s in zip(docs, sets, strict=True)}
    sums = {t: sum(s.values()) for t, s in sets.items()}
    holders = collections.defaultdict(list)
    for k, t in enumerate(texts):
        for s in sets[t]:
            holders[s].append(k)
    shared = collections.defaultdict(float)
    for s, ks in holders.items():
        for x in range(len(ks)):
            for y in range(x):
                shared[ks[y], ks[x]] += min(sets[texts[ks[x]]][s], sets[texts[ks[y]]][s])
    sims = {p: v / (sums[texts[p[0]]] + sums[texts[p[1]]] - v) for p, v in shared.items()}
    got = {r.doc_id: r.class_id for r in queries.op3_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    class_of = {r.text: got[r.doc_id] for r in docs}
    assert all(class_of[r.text] == got[r.doc_id] for r in docs)  # equal texts
    above = [p for p, v in sims.items() if v >= 0.81]
    found = sum(class_of[texts[a]] == class_of[texts[b]] for a, b in above)
    assert above and found >= 0.9 * len(above)
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), v in sims.items():
        if v >= 0.79:
            parent[top(a)] = top(b)
    members = collections.defaultdict(set)
    for k, t in enumerate(texts):
        members[class_of[t]].add(top(k))
    assert all(len(m) == 1 for m in members.values())


def test_near_duplicates_of_a_hot_group(spark, monkeypatch):
    """Many texts around one base, most of them too far from each other: no link of the exact classes is lost,
    and far fewer pairs are compared than there are."""
    rng = random.Random(11)
    base = prose(900, 150, words=5000).split()
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 4, 5, 6, 8, 10, 14))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9000)}"
        rows.append((i, " ".join(w), "a"))
    rows += [(1000 + i, f"{prose(950, 80)} {prose(1000 + i, 60, words=5000)}", "a") for i in range(120)]  # a shared passage
    compared, real = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *more: compared.append(pairs.count()) or real(pairs, *more))
    df = frame(spark, rows)
    idf = neardup.word_weights(*neardup.document_frequencies(df))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    want = exact_classes(rows, idf)
    pairs = [(a, b) for a in want for b in want if a < b and want[a] == want[b]]
    assert len(set(want.values())) > 30 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(compared) < 380 * 380 / 2 / 8


def test_near_duplicates_in_parts(spark, monkeypatch):
    """A leader's texts and a shingle's entries, dealt in parts, give the same classes."""
    rows = [(i, prose(5, 60).replace(f"w{i % 40}", f"x{i}", 1), "a") for i in range(40)] + [(100 + i, f"{prose(6, 30)} {prose(40 + i // 2, 30)}", "b") for i in range(30)]
    want = sorted(neardup.near_duplicates(frame(spark, rows)).collect())
    monkeypatch.setattr(neardup, "PART", 3)
    assert sorted(neardup.near_duplicates(frame(spark, rows)).collect()) == want


def test_prefix_pairs_lose_no_link(spark):
    """All pairs of different labels at or above the threshold are among the candidates."""
    rng = random.Random(12)
    base = prose(70, 60, words=800).split()
    rows = []
    for i in range(60):
        w = list(base[: rng.randrange(30, 60)])
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w), "a"))
    df = frame(spark, rows)
    array = neardup.word_weights(*neardup.document_frequencies(df))
    idf = spark.sparkContext.broadcast(array)
    texts = df.select(F.col("doc_id").alias("doc"), "text")
    labels = texts.select("doc", (F.col("doc") % 50).alias("label"))
    got = {(r.a, r.b) for r in neardup.prefix_pairs(labels, texts, idf, 0.8).collect()}
    import pyarrow as pa

    sets = {i: neardup.shingles(*neardup.text_words(pa.array([t])), array)[:2] for i, t, _ in rows}
    want = {(a, b) for a in sets for b in sets if a < b and a % 50 != b % 50 and neardup.similarity(sets[a], sets[b]) >= 0.8}
    assert want and want <= got and all(a % 50 != b % 50 for a, b in got)


def test_top_k_ships_each_block_once(spark):
    """Rows of the index are shipped once a team, queries once a block; both grow with the tables."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(900)]
    coded = hamming.coded(spark.createDataFrame(rows, "id long, embedding array<float>"))
    asked = coded.filter("id % 50 = 0")
    out = hamming.shipped(coded, asked, blocks=7, parts=4, groups=2).collect()
    index, wanted = [r for r in out if r.part is None], [r for r in out if r.part is not None]
    assert sum(len(r.ids) for r in index) == 900 * 8 * 2 and len(index) <= 14
    assert sum(len(r.ids) for r in wanted) == 18 * 8 * 7
    assert {(r.block, r.team) for r in wanted} <= {(b, t) for b in range(7) for t in range(2)}


def test_compacted_paths(spark):
    """Pieces that go on in both documents are one path; another source, a jump on either side, ends it."""
    pieces_ = [
        (9, 0, 0, 4, 1, 0, 10), (9, 0, 4, 3, 1, 0, 14), (9, 0, 7, 1, 1, 0, 17),  # one path of 8
        (9, 0, 9, 2, 1, 0, 19), (9, 0, 11, 2, 1, 0, 30), (9, 0, 13, 2, 2, 0, 32),  # a gap, a jump, another source
        (9, 1, 8, 5, 1, 0, 18), (8, 0, 8, 5, 1, 0, 18),
    ]
    got = substrings.compacted(spark.createDataFrame(pieces_, substrings._PIECES)).collect()
    want = [(9, 0, 0, 8, 1, 0, 10), (9, 0, 9, 2, 1, 0, 19), (9, 0, 11, 2, 1, 0, 30), (9, 0, 13, 2, 2, 0, 32), (9, 1, 8, 5, 1, 0, 18), (8, 0, 8, 5, 1, 0, 18)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_hot_passage(spark):
    """A passage in every document goes from all but the smallest."""
    passage = prose(33, 60)
    rows = [(i, f"{prose(2000 + i, 20)} {passage} {prose(3000 + i, 20)}", "a") for i in range(300)]
    out = substrings.remove_repeats(frame(spark, rows).repartition(7)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute_repeats(rows, 13)
    assert all(r.n_removed >= 60 for r in out if r.doc_id) and next(r.n_removed for r in out if not r.doc_id) == 0


def test_memory_of_a_batch_of_windows():
    """The windows of a batch are found in little more memory than their hashes take, and handed on piecemeal."""
    text = prose(5, 700_000, 90_000)
    whole = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["sub_doc", "sub_row", "text"])
    edges = substrings._edges(50, 13, 5, 8)
    list(edges(iter([whole.set_column(2, "text", pa.array([text[:20_000]]))])))  # tables that stay
    tracemalloc.start()
    sizes = [b.nbytes for b in edges(iter([whole]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) > 8 * 690_000 and max(sizes) < 2 << 20
    assert peak < 15 * 8 * 700_000


def test_revisits(spark):
    """A revisit names the record of its response, and is refused without it or with another payload."""
    html = "x" * 2000
    rows = [(1, "u", html), (5, "u", html), (5, "v", html), (7, "u", "short"), (9, "u", "y" * 30000)]
    archives = stored(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string")))
    heads = [h for r in archives.collect() for h, _ in warc.records(bytes(r.content))]
    names = {h["warc-record-id"]: h["warc-type"] for h in heads}
    assert len(names) == len(heads) - len(archives.collect()) + len({h["warc-record-id"] for h in heads if h["warc-type"] == "warcinfo"})
    target = [h["warc-refers-to"] for h in heads if h["warc-type"] == "revisit"]
    assert len(target) == 1 and names[target[0]] == "response"
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect()) == [(1, "revisit", 5), (5, "response", None), (5, "response", None), (7, "response", None), (9, "response", None)]
    alone = b"".join(warc.page_records(1, "u", html.encode(), 5))
    other = b"".join(warc.page_records(5, "u", b"z" * 2000, None))
    for content in (alone, alone + other):
        with pytest.raises(warc.WarcError, match="revisits no response"):
            warc.read_archives(spark.createDataFrame([("a", bytearray(content))], "archive string, content binary"))


def test_models_that_do_not_fit():
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    pieces.check_model(data)
    varint = lambda n: bytes([n])
    block = lambda field, body: varint(field << 3 | 2) + varint(len(body)) + body
    trainer = block(2, varint(3 << 3) + varint(2))
    rules = lambda *pairs: block(3, b"".join(varint(f << 3) + varint(v) for f, v in pairs))
    pieces.check_model(trainer + rules((3, 1), (4, 0)))
    for bad in (block(2, varint(3 << 3) + varint(1)), trainer + rules((3, 0), (4, 0)), trainer + rules((3, 1), (4, 1)), trainer + block(3, block(2, b"map"))):
        with pytest.raises(ValueError, match="the model"):
            pieces.check_model(bad)


#: What the operators call their own columns, inside and in their results.
NAMES = [
    "n_words", "n_removed", "n_paths", "kept_sha256", "sub_doc", "sub_paths", "line_doc", "line_out", "line_try", "n_lines", "n_bytes", "media", "feature", "n_tokens", "ids", "ids_sha256", "decoded",
    "round_trip", "refers_to", "copy", "page", "tree", "node", "score", "lang_pred", "near_doc", "class_id", "_mix_size", "_mix_copies", "_mix_other", "doc", "key", "gone",
]


def test_clashing_names(spark):
    """Columns named like an operator's new ones are replaced, all others come out as they went in."""
    rows = odd_rows()
    df = spark.createDataFrame([(*r, *(f"{c}!" for c in NAMES)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in NAMES)).withColumn("lang", F.lit("x"))
    made = {
        "substrings": (substrings.remove_repeats(df), {"n_words", "n_removed", "n_paths", "kept_sha256"}),
        "lines": (lines.dedup_lines(df), {"n_lines", "n_removed", "kept_sha256"}),
        "png": (png.decode(png.encode(df)), {"n_bytes", "media", "feature", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"}),
        "pieces": (pieces.decode(pieces.encode(df, digests=True)), {"n_tokens", "ids", "ids_sha256", "decoded_sha256", "round_trip", "decoded"}),
        "mixing": (mixing.mix(df), {"_mix_size", "_mix_source_size", "_mix_target", "_mix_copies", "_mix_time"}),
        "language": (language.predict(df, language.fit(df)), {"lang_pred", "score"}),
        "neardup": (neardup.keep_one(df), set()),
    }
    for name, (out, new) in made.items():
        got = out.collect()
        assert set(out.columns) == {*df.columns, *new} and len(out.columns) == len(set(out.columns)), name
        assert all(r[c] == f"{c}!" for r in got for c in NAMES if c not in new), name
        assert name == "neardup" or len(got) == len(rows)
    assert neardup.near_duplicates(df).count() == len(rows)
    pages = df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("source").alias("url"), *NAMES)
    assert warc.read_archives(stored(warc.write_archives(pages))).count() == len(rows)
    turns = df.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text", *NAMES)
    assert chat.format_trees(chat.threads(turns), best=1).count() == len({r[0] for r in rows})
    vectors = df.select(F.col("doc_id").alias("id"), F.array(*[F.length("text") * 1.0] * 4).alias("embedding"), *NAMES)
    assert hamming.top_k(vectors, vectors.filter("id = 5"), k=2).count() == 2


def test_scratch_on_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tessera.llm import common

    class Far:
        """A session of a cluster without the setting."""

        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://far:7077"
            getConf = staticmethod(lambda: Far.conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(Far)
    assert isinstance(stored_tables(), list)


PIPED = "doc_id long, text string, lang string, source string, n_chars long, near_doc string, line_doc string, _mix_size string, score string, n_lines int"


def piped(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "x", "x", "x", 1) for i, t, lang, s in rows], PIPED)


def test_stages_on_odd_rows(spark):
    """Null, blank, long and repeated texts, null ids, and columns named like the operators' own; empty tables."""
    import corpus_pipeline

    talk = {"aa": "the of and with that this from have been were", "bb": "der die und das nicht über für eine haben wird"}
    words = {k: v.split() for k, v in talk.items()}
    rng = random.Random(4)
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, "\n".join(say(lang, 9) for _ in range(6)), lang, "st"[i % 2]) for i in range(120) for lang in [["aa", "bb"][i % 2]]]
    rows += [(1000 + i, f"{say(lang, 3)} {i}", lang, "s") for i in range(80) for lang in [["aa", "bb"][i % 2]]]
    junk = [(500, "xkq zzv qxj " * 40, None, "s"), (501, "qxzjv kqxzj", None, "t"), (502, "12345 !!", "aa", "s")]
    odd = [(600, None, "aa", "s"), (601, "", None, "s"), (602, " \t\n", "bb", None), (None, rows[0][1], "aa", "s"), (None, say("bb", 80), None, None), (rows[1][0], rows[1][1], "bb", "t"), (700, say("aa", 9000), "aa", "s")]
    docs = piped(spark, rows + junk + odd)
    got = {name: stage(spark, docs, "") for name, stage in corpus_pipeline.STAGES}
    for name, out in got.items():
        assert name == "sentencepiece" or tuple(out.columns) == corpus_pipeline.COLUMNS
        assert stage_of(name)(spark, docs.limit(0), "").count() == 0
    kept = collections.Counter((r.doc_id, r.text) for r in got["language_id"].collect())
    assert kept == collections.Counter((i, t) for i, t, _, _ in rows + odd if t and t.strip())
    lined = collections.Counter(r.doc_id for r in got["line_dedup"].collect())
    assert not {600, 601, 602} & set(lined) and lined[rows[0][0]] == 1 and lined[rows[1][0]] == 1 and lined[500] == 1
    near = collections.Counter(r.text for r in got["minhash_near_dedup"].collect())
    assert near[None] == 1 and near[rows[1][1]] == 1 and near[rows[0][1]] == 1
    mixed = collections.Counter((r.doc_id, r.text) for r in got["mix_sources"].collect())
    assert all(t and t.strip() for _, t in mixed) and max(mixed.values()) <= 4
    assert got["sentencepiece"].count() == docs.count() and all((r.ids is None) == (r.doc_id == 600) for r in got["sentencepiece"].collect())
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert stage_of("language_id")(spark, unlabelled, "").count() == docs.count()


def stage_of(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


def test_stages_stay_readable(spark):
    """A stage's rows can be read again after later stages ran."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    one = stage_of("line_dedup")(spark, docs, SF)
    first = sorted(map(str, one.collect()))
    stage_of("minhash_near_dedup")(spark, one, SF).count()
    assert sorted(map(str, one.collect())) == first
