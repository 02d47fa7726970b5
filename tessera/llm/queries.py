"""The opN queries: each operator over its whole table with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, hamming, language, lines, mixing, neardup, pieces, png, substrings, warc
from tessera.llm.common import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mix(docs)
    return out.select(
        "doc_id", "source", F.col("_mix_size").alias("size"), F.col("_mix_source_size").cast("long").alias("source_size"),
        F.col("_mix_target").alias("target"), (F.col("_mix_copies") * F.col("_mix_size")).cast("long").alias("taken"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o, coalesce('0' || source, '1') AS s
  FROM documents),
z AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY s),
r AS (SELECT *, row_number() OVER (ORDER BY s) AS n, 2 * source_size AS cap FROM z),
w AS (SELECT *, CASE n % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM r),
v AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, n) AS k, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
                 - CAST(coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
                / CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM v),
m AS (SELECT arg_min(level, k) AS level FROM l WHERE ratio > level),
t AS (SELECT l.s, l.source_size, CASE WHEN m.level IS NULL OR m.level * weight >= cap THEN CAST(cap AS DOUBLE) ELSE m.level * weight END AS target
      FROM l LEFT JOIN m ON true),
f AS (SELECT d.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY d.s ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS served
      FROM d JOIN t ON t.s = d.s),
x AS (SELECT f.*, k, CAST(served + k * source_size AS DOUBLE) / target AS finish FROM f, (VALUES (0), (1)) p(k) WHERE size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, o, doc_id, k ROWS UNBOUNDED PRECEDING) AS used FROM x),
n AS (SELECT doc_id, o, served, s, count(*) AS copies FROM c WHERE used <= 1.5 * (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT f.doc_id, f.source, CAST(f.size AS BIGINT) AS size, f.source_size, f.target, CAST(coalesce(n.copies, 0) * f.size AS BIGINT) AS taken
FROM f LEFT JOIN n ON n.doc_id = f.doc_id AND n.served = f.served AND n.s = f.s AND f.size > 0
"""


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return hamming.top_k(vectors, vectors.filter("id % 50 = 0")).withColumnRenamed("id", "vec_id")


OP2_SQL = """
WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, len([i FOR i IN range(1, 65) IF (q.embedding[i] > 0) <> (v.embedding[i] > 0)]) AS distance
           FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM r WHERE rank <= 10
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, keep_text=False).drop("n_paths")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) t(i)),
m AS (SELECT g, min(doc_id) AS first FROM e GROUP BY g HAVING count(*) > 1),
r AS (SELECT e.doc_id, e.i FROM e JOIN m USING (g) WHERE m.first < e.doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, d.w, coalesce(len(c.gone), 0) AS n_removed,
             CASE WHEN c.gone IS NULL THEN d.w ELSE [d.w[j] FOR j IN range(1, len(d.w) + 1) IF NOT list_contains(c.gone, j)] END AS kept
      FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


def op5_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return png.decode(png.encode(docs, keep_text=False), keep_media=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = language.fit(docs)
    found = language.predict(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", F.coalesce(language.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(warc.write_archives(table(spark, sf_dir, "pages")))
    out = warc.read_archives(archives, keep_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT h, max(page_id) AS best FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to
FROM d LEFT JOIN m ON m.h = d.h AND d.n >= 1000
"""

PROBE = "</s>[INST] ok [/INST]"


def op8_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.threads(turns.unionByName(probe)), best=1)
    loss, back = chat.read_loss(F.col("formatted"), F.col("loss_spans")), chat.read_turns(F.col("formatted"))
    lines = F.array_join(F.transform(back, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    out = out.withColumn("loss", loss)
    return out.select(
        "conv_id", F.size(back).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -7, k, r, '{PROBE}', r, '{PROBE}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
l AS (SELECT *, length(regexp_replace(role, '{chat.ESCAPE}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{chat.ESCAPE}', '\1\\\2\3', 'g')) + {len(chat.START + chat.SEP + chat.END)} AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '') AS loss, sum(n) AS formatted_chars
      FROM l GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS ln, string_split(text, chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i)),
w AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
k AS (SELECT *, array_to_string(w, ' ') AS k, row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, ln) AS rn FROM w WHERE len(w) > 0),
f AS (SELECT doc_id, ln, w, k, len(w) AS n, row_number() OVER (ORDER BY doc_id, ln) AS pos FROM k WHERE rn = 1 AND len(w) >= 8),
v AS (SELECT pos, n, i, array_to_string(w[:i - 1], ' ') || chr(10) || array_to_string(w[i + 1:], ' ') AS s, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS d
      FROM f, unnest(range(1, n + 1)) u(i)),
r AS (SELECT s, n, i, min(pos) AS p FROM v GROUP BY ALL HAVING count(*) > 1),
near AS (
  SELECT v.pos FROM v JOIN r ON v.s = r.s AND v.n = r.n AND v.i = r.i AND r.p < v.pos
  UNION SELECT greatest(v.pos, f.pos) FROM v JOIN f ON v.d = f.k AND f.n = v.n - 1),
gone AS (SELECT doc_id, ln FROM k WHERE rn > 1 UNION SELECT doc_id, ln FROM f WHERE pos IN (SELECT pos FROM near)),
o AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.ln) AS n_removed, string_agg(CASE WHEN gone.ln IS NULL THEN line END, chr(10) ORDER BY l.ln) AS kept
      FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.ln = l.ln GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN o USING (doc_id)
"""


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, keep=False, digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mix_sources, op2_exact_top_k, op3_minhash_near_dedup, op4_substring_dedup, op5_media_png, op6_language_id, op7_warc_segments, op8_chat_trees, op9_line_dedup, op10_sentencepiece]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_exact_top_k": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op7_warc_segments": OP7_SQL, "op8_chat_trees": OP8_SQL, "op9_line_dedup": OP9_SQL}
