"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, langid, lexical, mixing, neardup_text, neardup_vec, pieces, quality, resample, secrets, sharding, webp, wrapper
from strandline.llm.base import cut, table

#: The vocabulary of op12, by its name among the public tokenizers' files.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_crc32 = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    placed = sharding.histogram_shards(table(spark, sf_dir, "documents"), extra={"text_crc32": text_crc32})
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify_languages(docs, langid.train_language_model(docs))


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select("doc_id", "text"), model).drop("text")


def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sample_segmentations(table(spark, sf_dir, "documents"))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vec.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digest_media(table(spark, sf_dir, "documents"))


def op9_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_text.near_duplicates(table(spark, sf_dir, "documents"))


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return wrapper.extract_articles(pages, cut(wrapper.induce_templates(pages)))


def op11_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_distinct_word_bpe(spark: SparkSession, sf_dir: str, ranks: str = VOCABULARY) -> DataFrame:
    known = bpe.read_ranks(public_tokenizers.path(ranks))
    return bpe.digest_encoding(bpe.encode_documents(table(spark, sf_dir, "documents"), known), known)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_source_mix": op2_source_mix,
    "op3_histogram_shards": op3_histogram_shards,
    "op4_language_id": op4_language_id,
    "op5_cross_polytope": op5_cross_polytope,
    "op6_quality_mil": op6_quality_mil,
    "op7_sentencepiece_sampling": op7_sentencepiece_sampling,
    "op8_lossless_webp": op8_lossless_webp,
    "op9_super_minhash": op9_super_minhash,
    "op10_wrapper_induction": op10_wrapper_induction,
    "op11_tput_search": op11_tput_search,
    "op12_distinct_word_bpe": op12_distinct_word_bpe,
    "op13_importance_resampling": op13_importance_resampling,
}


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes: each step adds the constants of the bits of its byte."""
    constants = []
    for k in range(8):
        c = 1 << k
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        constants.append(c)
    step = "c >> 8"
    for k, constant in enumerate(constants):
        step = f"xor({step}, (xor(c, b) >> {k} & 1) * {constant})"
    listed = f"list_transform(regexp_extract_all(hex(encode(coalesce({text}, ''))), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {listed}), lambda c, b: {step}), 4294967295::BIGINT)"


def _shards_sql(shards: int = 8, tolerance: str = "0.002") -> str:
    """Histogram sort as SQL: a round for each step of the probes; a splitter is open until it is near its goal."""
    steps = [1 << sharding.ID_BITS]
    while steps[-1] > 1:
        steps.append(max(1, steps[-1] // sharding.PROBES))
    rounds, span = [], 1 << (sharding.CELL_BITS + sharding.ID_BITS)
    for r, step in enumerate(steps):
        near = "TRUE" if step == 1 else "least(goal - below, below + more - goal) <= slack"
        rounds.append(f"""
c{r} AS (SELECT o.s, (d.key - o.lo) // {step} AS bin, sum(d.size)::BIGINT AS more FROM o{r} o JOIN d ON d.key >= o.lo AND d.key < o.lo + {span} GROUP BY 1, 2),
a{r} AS (SELECT o.s, o.goal, o.slack, o.lo + c.bin * {step} AS edge, c.more, (o.below + sum(c.more) OVER (PARTITION BY o.s ORDER BY c.bin) - c.more)::BIGINT AS below FROM c{r} c JOIN o{r} o ON o.s = c.s),
f{r} AS (SELECT *, {near} AS done FROM a{r} WHERE below + more > goal QUALIFY row_number() OVER (PARTITION BY s ORDER BY edge) = 1),
o{r + 1} AS (SELECT s, edge AS lo, below, goal, slack FROM f{r} WHERE NOT done)""")
        span = step
    found = " UNION ALL ".join(f"SELECT s, CASE WHEN goal - below <= below + more - goal THEN edge ELSE edge + {step} END AS key FROM f{r} WHERE done" for r, step in enumerate(steps))
    sql = f"""
WITH d AS (
  SELECT doc_id, text, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
         ('0x' || substr(md5(coalesce(text, '')), 1, {sharding.CELL_BITS // 4}))::BIGINT * {1 << sharding.ID_BITS} + ('0x' || substr(md5('id:' || coalesce(doc_id::VARCHAR, '')), 1, {sharding.ID_BITS // 4}))::BIGINT AS key
  FROM documents),
t AS (SELECT coalesce(sum(size), 0)::BIGINT AS total FROM d),
o0 AS (SELECT s::INT AS s, 0::BIGINT AS lo, 0::BIGINT AS below, total * s / {shards}::DOUBLE AS goal, {tolerance}::DOUBLE * total / {shards}::DOUBLE AS slack FROM t, range(1, {shards}) r(s)),{",".join(rounds)},
k AS (SELECT s, max(key) OVER (ORDER BY s) AS key FROM ({found})),
p AS (SELECT d.*, (SELECT count(*) FROM k WHERE d.key >= k.key)::INT AS shard FROM d)
SELECT doc_id, size, CRC32_OF_TEXT AS text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY key, doc_id, size) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM p"""
    return sql.replace("CRC32_OF_TEXT", _crc32_sql("text"))


def _resample_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))"
    return f"""
WITH d AS (SELECT doc_id, len(ws) AS n_words, {runs} AS fs FROM (SELECT doc_id, {words} AS ws FROM documents)),
b AS (SELECT {runs} AS fs FROM (SELECT {words} AS ws FROM benchmark)),
df AS (SELECT doc_id, f, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(fs) AS f FROM d) GROUP BY doc_id, f),
bf AS (SELECT f, count(*)::BIGINT AS n FROM (SELECT unnest(fs) AS f FROM b) GROUP BY f),
h AS (SELECT f, (CRC32_OF_F % 10000)::INT AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM df JOIN h USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bf JOIN h USING (f) GROUP BY bucket),
k AS (SELECT (SELECT coalesce(sum(s), 0) + 10000 FROM s)::DOUBLE AS big_s, (SELECT coalesce(sum(t), 0) + 10000 FROM t)::DOUBLE AS big_t),
g AS (SELECT r.i::INT AS bucket, floor(1000 * ln((coalesce(t, 0) + 1) * big_s / ((coalesce(s, 0) + 1) * big_t)))::BIGINT AS gain FROM range(10000) r(i) LEFT JOIN s ON s.bucket = r.i LEFT JOIN t ON t.bucket = r.i, k),
w AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY doc_id),
e AS (SELECT d.doc_id, n_words, len(fs)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM d LEFT JOIN w ON d.doc_id = w.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS able FROM e WHERE n_words >= 20)
SELECT e.doc_id, n_features, weight, (weight + noise)::BIGINT AS score, CASE WHEN rank <= able * 5 // 100 THEN rank END::BIGINT AS rank FROM e LEFT JOIN r ON e.doc_id = r.doc_id""".replace("CRC32_OF_F", _crc32_sql("f"))


ORACLE_SQL: dict[str, str] = {
    "op13_importance_resampling": _resample_sql(),
    "op11_tput_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(ts))::BIGINT AS big_l FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM c WHERE score > 0 QUALIFY rank <= 50""",
    "op2_source_mix": """
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS okey
  FROM documents),
t0 AS (SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey) - 1 AS pos FROM d GROUP BY skey),
t1 AS (SELECT *, CASE pos % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 2.0::DOUBLE * source_size AS most FROM t0),
t2 AS (SELECT *, most / weight AS ratio, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS goal FROM t1),
t3 AS (SELECT *, (goal - coalesce(sum(most) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM t2),
t4 AS (SELECT *, (SELECT level FROM t3 WHERE level <= ratio ORDER BY ratio, skey LIMIT 1) AS chosen FROM t3),
t AS (SELECT skey, source_size, goal, least(most, coalesce(chosen * weight, most)) AS target FROM t4),
w0 AS (SELECT skey, source_size, target, goal, round(target)::BIGINT AS words, ((source_size + 255) // 256)::BIGINT AS blocks, (round(target)::BIGINT // source_size)::BIGINT AS rounds, (round(target)::BIGINT % source_size)::BIGINT AS rest,
              sum(target) OVER (ORDER BY skey ROWS UNBOUNDED PRECEDING) / goal AS upto_share, row_number() OVER (ORDER BY skey) - 1 AS nth, count(*) OVER () AS sources FROM t WHERE source_size > 0),
w AS (SELECT *, rounds * blocks + (rest + 255) // 256 AS needed, lag(upto_share, 1, 0.0::DOUBLE) OVER (ORDER BY skey) AS lo, CASE WHEN nth = sources - 1 THEN 2.0::DOUBLE ELSE upto_share END AS hi FROM w0),
points AS (SELECT i::BIGINT AS slot, (i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE - floor((i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) AS u FROM range((SELECT coalesce(ceil(max(goal) / 256), 0)::BIGINT FROM t)) r(i)),
dealt AS (SELECT w.skey, slot, row_number() OVER (PARTITION BY w.skey ORDER BY slot) - 1 AS rank FROM points JOIN w ON u >= lo AND u < hi),
given AS (SELECT w.skey, count(dealt.slot) AS given FROM w LEFT JOIN dealt ON w.skey = dealt.skey GROUP BY w.skey),
every AS (SELECT * FROM dealt UNION ALL SELECT w.skey, (SELECT count(*) FROM points) + r.rank * w.sources + w.nth, r.rank FROM w JOIN given ON w.skey = given.skey, LATERAL (SELECT unnest(range(given.given, w.needed)) AS rank) r),
slots AS (SELECT e.skey, e.slot, e.rank % w.blocks AS block, CASE WHEN e.rank // w.blocks >= w.rounds THEN least(256, w.rest - (e.rank - w.rounds * w.blocks) * 256) ELSE 256 END AS upto FROM every e JOIN w ON e.skey = w.skey WHERE e.rank < w.needed),
p AS (SELECT d.doc_id, d.skey, d.size, t.source_size, t.target, row_number() OVER () AS row_id,
             (sum(d.size) OVER (PARTITION BY d.skey ORDER BY d.okey, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - d.size AS a
      FROM d JOIN t ON d.skey = t.skey),
b AS (SELECT row_id, skey, a, size, unnest(range(a // 256, (a + size - 1) // 256 + 1)) AS block FROM p WHERE size > 0),
r AS (SELECT b.row_id, s.slot, least(b.a + b.size - b.block * 256, 256, s.upto) - greatest(b.a - b.block * 256, 0) AS n FROM b JOIN slots s ON s.skey = b.skey AND s.block = b.block WHERE s.upto > greatest(b.a - b.block * 256, 0)),
k AS (SELECT row_id, sum(n)::BIGINT AS taken, min(slot)::BIGINT AS first_slot, count(*)::BIGINT AS n_slots FROM r GROUP BY row_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots FROM p LEFT JOIN k ON p.row_id = k.row_id""",
    "op3_histogram_shards": _shards_sql(),
    "op5_cross_polytope": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN m ON e.vec_id = m.id LEFT JOIN n ON e.vec_id = n.a""",
    "op9_super_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN m ON d.doc_id = m.id LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op10_wrapper_induction": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS art FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(replace(art, '<br>', ' '), '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>')) AS parts FROM b),
d AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM c)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, length(array_to_string(blocks, chr(10) || chr(10)))::BIGINT AS n_chars FROM d""",
}
