"""Operators on small fixtures against brute force: nulls, blank and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, hamming, language, lines, mixing, neardup, pieces, png, substrings, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, line string, n int"


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def frame(spark, rows):
    """doc_id, text, source and columns whose names operators might use themselves."""
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], DOCS)


def odd_rows():
    """Null and blank texts, a long one, repeated rows, a null id and source."""
    base = prose(1, 60)
    return [
        (5, base, "a"), (3, base, "a"), (3, base, "a"), (9, None, None), (10, "", "b"), (11, " \t\n ", "b"), (None, base, "a"), (12, "one", "b"),
        (13, base.replace(base.split()[30], "changed", 1), "b"), (20, prose(2, 5000), "a"), (21, "\n".join([base] * 3), "c"), (22, "é ü 日本 😀", "c"),
    ]


def as_dict(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_mix(spark):
    rows = odd_rows() + [(100 + i, prose(i, 20 + i % 7), "abc"[i % 3]) for i in range(300)]
    out = mixing.mix(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    taken, sizes, target = {}, {}, {}
    for r in out:
        n = len(WORDS.findall(r.text or ""))
        assert r._mix_size == n and 0 <= r._mix_copies <= 2 and (n or not r._mix_copies)
        taken[r.source] = taken.get(r.source, 0) + n * r._mix_copies
        sizes[r.source] = sizes.get(r.source, 0) + n
        target[r.source] = r._mix_target
    budget = 1.5 * sum(sizes.values())
    assert sum(taken.values()) <= budget and abs(sum(target.values()) - budget) < 1e-6
    for s in sizes:
        assert target[s] <= 2 * sizes[s] and abs(taken[s] - target[s]) <= 5000 + 60
    again = mixing.mix(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r._mix_copies) for r in again) == sorted((r.doc_id or -1, r._mix_copies) for r in out)
    assert mixing.mix(frame(spark, [])).collect() == []


def test_mix_of_one_id(spark):
    """Null ids and a repeated id take the same turns in whatever order their rows come."""
    rows = [(None, prose(i, 5 + i % 40), "ab"[i % 2]) for i in range(80)] + [(7, prose(200 + i, 9 + i), "a") for i in range(20)] + [(900 + i, prose(i, 30), "b") for i in range(40)]
    one, two = (mixing.mix(frame(spark, r).coalesce(1)).select("doc_id", "text", "_mix_copies", "_mix_time").collect() for r in (rows, rows[::-1]))
    assert sorted(map(str, one)) == sorted(map(str, two)) and len({r._mix_time for r in one if r.doc_id is None}) > 70


def test_targets(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 0}
    df = spark.createDataFrame(list(sizes.items()), "_mix_source string, _mix_source_size long")
    got = {r._mix_source: r._mix_target for r in mixing.source_targets(df).collect()}
    weights, caps, left, want = dict(zip("abcd", (3, 1, 2, 3))), {k: 2 * v for k, v in sizes.items()}, 1.5 * 1110, {}
    free = set(sizes)
    while free:  # reshare until none is above
        share = left / sum(weights[k] for k in free)
        over = {k for k in free if share * weights[k] >= caps[k]}
        want |= {k: float(caps[k]) for k in over} or {k: share * weights[k] for k in free}
        left -= sum(caps[k] for k in over)
        free = free - over if over else set()
    assert got == pytest.approx(want)


def brute_repeats(rows, k):
    first = {}
    docs = [(substrings.NULL_ID if i is None else i, WORDS.findall(t or "")) for i, t, _ in rows]
    for i, w in docs:
        for j in range(len(w) - k + 1):
            first[tuple(w[j : j + k])] = min(i, first.get(tuple(w[j : j + k]), i))
    out = {}
    for i, w in docs:
        gone = {x for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for x in range(j, j + k)}
        out[None if i == substrings.NULL_ID else i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batch", [1, 1 << 20])
def test_substrings(spark, batch, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", batch)
    passage = prose(50, 40)
    rows = odd_rows() + [(200 + i, f"{prose(60 + i, 30)} {passage} {prose(90 + i, i)}", "a") for i in range(12)]
    out = substrings.remove_repeats(frame(spark, rows))
    assert as_dict(out, "n_words", "n_removed", "kept_sha256") == brute_repeats(rows, 13)
    assert out.columns[:5] == ["doc_id", "text", "source", "line", "n"] and out.count() == len(rows)
    assert substrings.remove_repeats(frame(spark, [])).collect() == []


def own_repeats(rows, k=13):
    """What brute_repeats gives, of each row by itself: rows of one id need not have one text."""
    docs = [(substrings.NULL_ID if i is None else i, WORDS.findall(t or "")) for i, t, _ in rows]
    first = {}
    for i, w in docs:
        for j in range(len(w) - k + 1):
            first[tuple(w[j : j + k])] = min(i, first.get(tuple(w[j : j + k]), i))
    gone = [{x for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for x in range(j, j + k)} for i, w in docs]
    return sorted((i, len(w), len(g), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in g).encode()).hexdigest()) for (i, w), g in zip(docs, gone, strict=True))


@pytest.mark.parametrize(("batch", "width"), [(1, 7), (1 << 20, 7), (1, 1), (1 << 20, 1)])
def test_substrings_of_one_id(spark, batch, width, monkeypatch):
    """Several null ids and a repeated id with different texts; hashes of one byte, which many windows share."""
    monkeypatch.setattr(substrings, "BATCH_BYTES", batch)
    monkeypatch.setattr(substrings, "HASH_BYTES", width)
    passage, other = prose(50, 40), prose(51, 30)
    rows = odd_rows() + [(200 + i, f"{prose(60 + i, 30)} {passage}", "a") for i in range(5)]
    rows += [(None, f"{other} {passage} {prose(70 + i, 9)}", "a") for i in range(3)] + [(None, prose(80, 60), "a"), (None, None, "a")]
    rows += [(2, passage, "a"), (2, f"{prose(81, 20)} {other}", "a"), (2, prose(82, 70), "a"), (300, other, "a"), (300, f"x {passage}", "a")]
    out = substrings.remove_repeats(frame(spark, rows)).collect()
    assert sorted((substrings.NULL_ID if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == own_repeats(rows)


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 50)
    for w in range(1, 12):
        assert substrings.sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(50 - w + 1)]


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    data = np.random.default_rng(kind).integers(0, 256, 64 * 9, dtype=np.uint8).tobytes()
    media = png.write_png(data, kind)
    assert png.read_png(media).tobytes() == data
    for at in (3, 20, 60, len(media) - 6):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises((png.MediaError, zlib.error)):
            png.read_png(bytes(bad))
    with pytest.raises(png.MediaError):
        png.read_png(media[:-12])


def test_png(spark):
    rows = odd_rows()
    out = png.decode(png.encode(frame(spark, rows))).collect()
    for r in out:
        data = (r.text or "").encode()
        whole = data + bytes(max(1, -(-len(data) // 64)) * 64 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert r.media_bytes == len(r.media) and len(r.feature) == 16
    same = [r for r in out if r.text == rows[0][1]]
    assert len(same) == 4 and len({(r.feature, r.media_sha256) for r in same}) == 1
    assert png.decode(png.encode(frame(spark, []))).collect() == []


def test_language(spark):
    rng = random.Random(3)
    talk = {"aa": "the of and with that this from".split(), "bb": "der die und das nicht über für".split()}
    rows = [(i, " ".join(rng.choice(talk[lang]) for _ in range(20)), lang) for i in range(200) for lang in [["aa", "bb"][i % 2]]]
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "123 !?", "aa"), (303, "über für", None), (None, "the of", "aa"), (304, "日本語", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = as_dict(language.predict(df.withColumn("score", F.lit("x")), language.fit(df)), "lang_pred", "score")
    assert all(got[i][0] == lang and 0 <= got[i][1] <= 1 for i, _, lang in rows[:200])
    assert all(got[i] == ("und", 0.0) for i in (300, 301, 302)) and got[303][0] == "bb" and got[304][0] in ("aa", "bb")
    none = language.predict(df, language.fit(df.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"} and none.count() == len(rows)


def test_rare_language(spark):
    """A sample far smaller than the labelled rows still holds every language."""
    rows = [(i, "the of and with that", "aa") for i in range(3000)] + [(9000 + i, "über für nicht das", "bb") for i in range(3)]
    assert set(language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=4)) == {"aa", "bb"}


def test_all_rows_teach(spark):
    """Prototypes and bounds come from every teaching row, however many there are."""
    noise = F.translate(F.xxhash64("id").cast("string"), "-0123456789", "abcdeabcdea")
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("the of "), F.substring(noise, 1, (F.col("id") % 17).cast("int")))).otherwise(F.lit("der die und"))
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 == 0, "aa").otherwise("bb").alias("lang"))
    teach = docs.filter(language.fold(F.col("doc_id")) != 1)
    prototypes = language.fit(docs)
    assert np.linalg.norm(prototypes["bb"]) / 2**20 == pytest.approx(teach.filter("lang = 'bb'").count(), rel=1e-3)
    scores = {}
    for r in language.predict(teach, prototypes).collect():
        scores.setdefault(int(np.log2(sum(map(str.isalpha, r.text)))), []).append(r.score)
    bounds = language.score_bounds(docs, prototypes)
    assert len(scores) > 2
    for size, found in scores.items():
        low = sorted(found)[-(-len(found) // 100) - 1]
        assert bounds[size] == pytest.approx(int(low * language.STEPS) / language.STEPS / 2, abs=1e-9)


def test_trigram_blocks():
    texts = [prose(1, 300), "", "日本 語", "AbC abc"]
    whole = language.text_vectors(texts)[0]
    for t, v in zip(texts, whole, strict=True):
        assert np.array_equal(language.text_vectors([t])[0][0], v)


def test_warc(spark):
    big = prose(1, 9000)
    same = prose(2, 300)
    rows = [(1, "http://a/1", same), (7, "http://a/7", same), (3, None, same), (4, "u", None), (5, "u", "x" * 999), (6, "u", "x" * 999), (8, "u v\n", big), (9, "u", "é" * 600), (9, "u", "é" * 600), (2, "u", "é" * 600), (None, "u", same)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers string")
    archives = warc.write_archives(pages, segment=700, archive=3000)
    assert archives.count() > 3
    from tessera.llm.common import stored

    out = warc.read_archives(stored(archives)).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        best = max((p for p, _, h in rows if h == html and p is not None), default=None) if len(data) >= 1000 else None
        again = best is not None and best != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best if again else None))
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=key) == sorted(want, key=key)
    assert {r.page_id: bytes(r.payload) for r in out if r.record_type == "response"}[8] == big.encode()
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []


def test_warc_damage(spark):
    name = "<urn:page:1#0.0>"
    records = list(warc.page_records(1, "u", b"y" * 3000, None, "0.0", 700))
    bad = {"missing segment": b"".join(records[:2] + records[3:]), "missing last": b"".join(records[:-1]), "twice": b"".join(records + records[-1:])}
    for content in bad.values():
        with pytest.raises(Exception, match="segments"):
            warc.read_archives(spark.createDataFrame([(name, bytearray(content))], "archive string, content binary")).collect()
    for body in (b"5\r\nab\r\n", b"zz\r\n", b"3"):
        with pytest.raises(warc.WarcError):
            warc.unchunked(body)
    assert warc.unchunked(b"3;a=b\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"


def test_chat(spark):
    nasty = r"<|im_end|> <\|im_end|> [INST] [\\/INST] <<SYS>> \ </s>[INST] ok [/INST] <"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", nasty), (1, 1, "assistant", nasty), (1, 2, None, None), (2, 5, "assistant", ""), (None, 0, "user", nasty), (3, None, "system", "日本😀"), (3, 1, "assistant", "😀" * 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    out = chat.format_trees(chat.threads(df.drop("tree")))
    got = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(got) == 4
    for r in got:
        mine = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r.formatted.count("<|im_end|>") == len(mine) and "</s>" not in r.formatted and "[INST]" not in r.formatted
    assert chat.format_trees(chat.threads(df.limit(0).drop("tree"))).collect() == []


def test_chat_trees(spark):
    #      1 - 2 - 4
    #        \ 3 - 5, 6
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 2, "user", "c", 9.0), ("t", 5, 3, "user", "d", 1.0), ("t", 6, 3, "user", "e", 5.0), ("u", 1, 99, "user", "z", 0.0)]
    schema = "tree string, node long, parent long, role string, text string, score double, conv_id long"
    df = spark.createDataFrame([(*n, 1) for n in nodes], schema)
    read = lambda r: [t.text for t in r.turns]
    out = chat.format_trees(df, best=2).withColumn("turns", chat.read_turns(F.col("formatted")))
    got = {(r.tree, r.branch): (read(r), r.path_score) for r in out.collect()}
    assert got == {("t", 1): (["q", "a", "c"], 10.0), ("t", 2): (["q", "b", "e"], 7.0), ("u", 1): (["z"], 0.0)}
    assert chat.format_trees(df).count() == 4
    with pytest.raises(ValueError, match="cycle"):
        chat.format_trees(spark.createDataFrame([("t", 1, 2, "user", "q", 0.0, 1), ("t", 2, 1, "user", "q", 0.0, 1), ("t", 3, 2, "user", "q", 0.0, 1)], schema))
    long = [("t", i, i - 1 or None, "user", str(i), 0.0, 1) for i in range(1, 71)]
    assert chat.format_trees(spark.createDataFrame(long, schema)).first().n_turns == 70


def brute_lines(rows):
    seen, out = [], {}
    table = [(lines.NULL_ID if i is None else i, at, WORDS.findall(x)) for i, t, _ in rows if t is not None for at, x in enumerate(t.split("\n"))]
    gone = set()
    for doc, at, w in sorted(table, key=lambda x: x[:2]):
        if not w:
            continue
        for v in seen:
            near = v == w
            if not near and min(len(v), len(w)) >= lines.MIN_WORDS and abs(len(v) - len(w)) <= 1:
                near = sum(a != b for a, b in zip(v, w)) == 1 if len(v) == len(w) else any(x == y for x, y in [(max(v, w, key=len)[:i] + max(v, w, key=len)[i + 1 :], min(v, w, key=len)) for i in range(max(len(v), len(w)))])
            if near:
                gone.add((doc, at))
                break
        seen.append(w)
    for i, t, _ in rows:
        key = lines.NULL_ID if i is None else i
        split = t.split("\n") if t is not None else []
        kept = [x for at, x in enumerate(split) if (key, at) not in gone]
        out[i] = (len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept) if t is not None else None)
    return out


def test_lines(spark):
    rng = random.Random(5)
    rows = [(i, t, s) for i, t, s in odd_rows() if i != 3]
    for i in range(30, 70):
        doc = []
        for _ in range(6):
            w = prose(rng.randrange(5), rng.choice((7, 8, 9, 15, 16, 17, 31, 32, 33))).split()
            at = rng.randrange(len(w))
            how = rng.randrange(5)
            w = w[:at] + {0: ["new"], 1: [], 2: [w[at], "more"]}.get(how, [w[at]]) + w[at + 1 :]
            doc.append("  ".join(w))
        rows.append((i, "\n".join(doc + ["", "short", "short"]), "a"))
    want = brute_lines(rows)
    out = lines.dedup_lines(frame(spark, rows))
    assert as_dict(out, "n_lines", "n_removed", "kept_sha256", "text") == want
    assert as_dict(lines.dedup_lines(frame(spark, rows), keep_text=False), "n_lines", "n_removed", "kept_sha256") == {k: v[:3] for k, v in want.items()}
    assert lines.dedup_lines(frame(spark, [])).collect() == []
    assert lines.dedup_lines(frame(spark, [(1, "a b\na b", "x")] * 2)).count() == 2


def test_lines_of_one_id(spark):
    """Repeated rows, several null ids and a repeated id with different texts, each row by itself."""
    rng = random.Random(6)
    shared = [prose(i, 12) for i in range(6)]
    rows = odd_rows()
    for i in [None, None, None, None, 4, 4, 4, 300, 301, 301]:
        doc = [rng.choice(shared), prose(rng.randrange(99), 9), rng.choice(shared).replace("w1", "v1", 1), "", "short", prose(rng.randrange(9), 10)]
        rows.append((i, "\n".join(doc), "a"))
    rows += [(None, "\n".join(shared[:3]), "a")] * 2 + [(None, "\n".join([shared[0], prose(900 + k, 14)]), "a") for k in range(3)] + [(None, None, "a")] * 2
    hashes = [r.h for r in frame(spark, rows).select(F.xxhash64("text").alias("h")).collect()]
    order = sorted(range(len(rows)), key=lambda k: (lines.NULL_ID if rows[k][0] is None else rows[k][0], hashes[k]))
    # rows numbered in their order have ids of their own, as the brute force needs
    want = brute_lines([(n, rows[k][1], None) for n, k in enumerate(order)])
    want = sorted(((rows[k][0], *want[n]) for n, k in enumerate(order)), key=str)
    out = lines.dedup_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_removed", "kept_sha256", "text")
    assert sorted(map(tuple, out.collect()), key=str) == want


def exact_classes(rows, idf):
    import pyarrow as pa

    ids = [neardup.NULL_ID if i is None else i for i, _, _ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = []
    for _, t, _ in rows:
        h, w, _ = neardup.shingles(*neardup.text_words(pa.array([t or ""])), idf)
        sets.append((h, w))
    for a, b in itertools.combinations(range(len(rows)), 2):
        same = ids[a] == ids[b] or (rows[a][1] is not None and rows[a][1] == rows[b][1])
        if same or neardup.similarity(sets[a], sets[b]) >= neardup.THRESHOLD:
            parent[top(a)] = top(b)
    least = {}
    for k in range(len(rows)):
        least[top(k)] = min(least.get(top(k), ids[k]), ids[k])
    back = lambda x: None if x == neardup.NULL_ID else x
    return {back(ids[k]): back(least[top(k)]) for k in range(len(rows))}


def test_near_duplicates(spark):
    rng = random.Random(8)
    rows = odd_rows()
    for g in range(12):
        base = prose(g + 300, 120).split()
        for c in range(rng.choice((1, 2, 12))):
            w = list(base)
            for _ in range(rng.choice((0, 1, 1, 2))):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
            rows.append((1000 + g * 50 + c, " ".join(w), "a"))
    df = frame(spark, rows)
    idf = neardup.word_weights(*neardup.document_frequencies(df))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == exact_classes(rows, idf)
    kept = neardup.keep_one(df)
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").distinct().collect()) == sorted(map(str, set(got.values()))) and kept.columns == df.columns
    assert neardup.near_duplicates(frame(spark, [])).collect() == []


def test_near_duplicates_of_one_id(spark):
    """Null ids and a repeated id with different texts: each row has the class of its own text."""
    a, b, c, d = (prose(700 + k, 120) for k in range(4))
    near = lambda t: t.replace(t.split()[60], "edited", 1)
    rows = [(8, a), (None, near(a)), (None, b), (None, near(b)), (None, b), (None, c), (None, None), (None, None), (6, a), (6, d), (7, near(d)), (9, d), (9, c), (5, "short"), (5, "short"), (4, None), (4, None)]
    df = frame(spark, [(i, t, "a") for i, t in rows])
    want = {a: 6, near(a): 6, b: None, near(b): None, c: 9, d: 6, near(d): 6, "short": 5}
    got = [(r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(((i, want[t] if t is not None else i) for i, t in rows), key=str)
    kept = [(r.doc_id, r.text) for r in neardup.keep_one(df).collect()]
    assert sorted((x for x in kept if x[1] not in (b, near(b))), key=str) == sorted([(6, a), (6, d), (9, c), (None, None), (None, None), (5, "short"), (4, None), (4, None)], key=str)
    assert len([x for x in kept if x[1] in (b, near(b))]) == 1


def test_sampling_rate():
    """Draws agree as often as the weighted Jaccard similarity says."""
    rng = np.random.default_rng(2)
    hashes = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    a, b = rng.uniform(0.5, 9, 300).astype(np.float32), rng.uniform(0.5, 9, 300).astype(np.float32)
    want = neardup.similarity((hashes, a), (hashes, b))
    tables = neardup.sample_tables(600)
    drawn = neardup.draws(np.concatenate([hashes, hashes]), np.concatenate([a, b]), np.array([0, 300, 600]), tables, 600)
    assert abs((drawn[0] == drawn[1]).mean() - want) < 0.07
    assert neardup.band_keys(drawn).shape == (2, 150)


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (12, 11), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.doc: r.class_id for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 6)} | {10: 10, 11: 10, 12: 10} | {100 + i: 100 for i in range(41)}


def test_components_of_several_lows(spark):
    """A doc without a smaller neighbour whose neighbours hook to others."""
    links = [(1, 9), (4, 9), (6, 9), (6, 12), (5, 12), (-3, 20), (8, 20), (8, 21), (7, 21)]
    got = {r.doc: r.class_id for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in (1, 4, 5, 6, 9, 12)} | {i: -3 for i in (-3, 7, 8, 20, 21)}


@pytest.mark.parametrize("dims", [64, 10])
def test_top_k(spark, dims):
    rng = np.random.default_rng(4)
    vectors = [rng.standard_normal(dims).tolist() for _ in range(150)]
    vectors += [vectors[0]] * 30
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(3, vectors[3], "x"), (900, None, "x"), (None, vectors[1], "x"), (901, [float("nan")] * dims, "x")]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, block string")
    queries = df.filter("id % 50 = 0")
    out = hamming.top_k(df, queries, k=7, block_rows=60, query_rows=2)
    import pyarrow as pa

    codes, valid = hamming.codes_of(pa.array([v for _, v, _ in rows], pa.list_(pa.float32())))
    known = [(i, int(c)) for (i, _, _), c, ok in zip(rows, codes, valid, strict=True) if ok and i is not None]
    want = []
    for q, c in known:
        if q % 50 == 0:
            near = sorted(((c ^ d).bit_count(), i) for i, d in known)[:7]
            want += [(q, k, i, d) for k, (d, i) in enumerate(near, 1)]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert hamming.top_k(df.limit(0), queries.limit(0)).collect() == []


def test_pieces(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = odd_rows() + [(50, "  Hello   world\n\t x", "a"), (51, "</s> <s> <0x0A> a▁b", "a"), (52, "日本語 한국어 😀\x00", "a"), (53, "a" * 400, "a"), (54, " ", "a"), (55, "ﬁ Å é é 1234", "a")]
    out = pieces.decode(pieces.encode(frame(spark, rows), digests=True)).collect()
    for r in out:
        if r.text is None:
            assert r.ids is None and r.decoded is None and r.n_tokens is None
            continue
        assert r.ids == model.encode(r.text) and r.n_tokens == len(r.ids) and r.decoded == model.decode(r.ids) and r.round_trip
    assert pieces.encode(frame(spark, [])).collect() == []


def test_pieces_on_texts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = pieces.encode_batch(texts, pieces.load())
    assert [g.tolist() for g in got] == model.encode(texts)
