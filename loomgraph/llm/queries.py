"""Driver queries of the text operators: each reads its whole table and applies its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bitpack, chroma, crosstoken, decontaminate, katz, langid, neardup, packing, quality, secrets, shared, spelling, suffixdedup, warc

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated pairs of documents and benchmark items."""
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("tiles", "row_key")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.filter(~langid.in_test()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.in_test().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return packing.pack(shared.written(pieces, "pieces"))


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.train_and_score(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op6_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no recordings: each document's bytes are taken as its samples."""
    return chroma.groups(documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("samples")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(documents(spark, sf_dir), width=3, percent=85)


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.read(warc.write(pages, shared.new_path(spark, "warc")))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.new_path(spark, "token-ids")
    return bitpack.read(bitpack.write(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), folder))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(documents(spark, sf_dir)))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.summary(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.filter(~quality.in_test()))
    found = quality.score(docs, model)
    return found.select("doc_id", quality.in_test().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_decontamination, op3_language_id, op4_best_fit_packing, op5_katz_backoff, op6_chroma_fingerprints, op7_minhash_near_dedup, op8_warc_bundles, op9_token_ids, op10_suffix_array_dedup, op11_spelling_variants, op12_cross_tokenizer_alignment, op13_quality_classifier)}
#: Words, lower-cased in A-Z, of each document; distinct runs of three words; pairs that share one; what is reachable over links.
OP7 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, least(sets.doc_id, coalesce(min(b), sets.doc_id)) AS component_id, sets.doc_id = least(sets.doc_id, coalesce(min(b), sets.doc_id)) AS kept
FROM sets LEFT JOIN reach ON reach.a = sets.doc_id GROUP BY sets.doc_id, s"""

#: Base 32 of the SHA-1: eight letters for every ten hexadecimal digits.
OP8 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS least_id FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (10 * (i // 8) + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = least_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least_id THEN least_id END AS refers_to FROM f"""

#: Bytes as two hexadecimal digits; windows of 50 bytes that also start in a smaller document; their unions; what is left between them.
OP10 = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 49))) AS i FROM t)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS least_id FROM w) WHERE least_id < doc_id),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true)::INT AS fresh FROM c)),
s AS (SELECT doc_id, run, min(i) AS b, max(i) + 50 AS e FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS b, b AS e FROM s UNION ALL SELECT doc_id, max(e), 1000000000 FROM s GROUP BY doc_id),
kept AS (SELECT k.doc_id, string_agg(substr(h, 2 * b + 1, 2 * (e - b)), '' ORDER BY b) AS h FROM k JOIN t ON t.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT t.doc_id, (len(t.h) // 2)::BIGINT AS n_bytes, coalesce(g.removed, 0)::BIGINT AS n_removed, coalesce(g.n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, t.h))) AS kept_sha256
FROM t LEFT JOIN (SELECT doc_id, sum(e - b) AS removed, count(*) AS n FROM s GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept ON kept.doc_id = t.doc_id"""

#: CRC-32 of the bytes of '<doc_id>:<run>' by its table of 256 steps; near words are those that share a word with a hole at
#: one place (replaced), or one of them is the other with a hole closed (inserted, deleted); forms are followed to their end.
OP11 = """WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_transform(range(8), lambda i: 0::BIGINT), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n::BIGINT)) AS steps),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS h FROM k, t),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM d GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
o AS (SELECT word, n, i, substr(word, 1, i) AS l, substr(word, i + 2) AS r FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b, b.n AS b_n FROM o a JOIN o b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
 UNION SELECT o.word, v.word, v.n FROM o JOIN v ON v.word = o.l || o.r UNION SELECT v.word, o.word, o.n FROM o JOIN v ON v.word = o.l || o.r),
g AS (SELECT a, count(*)::BIGINT AS n_near, min((-b_n, b)) AS best FROM p GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= 2 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * n THEN -best[1] END::BIGINT AS form_n FROM v LEFT JOIN g ON g.a = v.word),
c(word, z) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.z WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.z AS root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word) JOIN f e ON e.word = c.z WHERE e.form IS NULL"""

ORACLES: dict[str, str] = {"op7_minhash_near_dedup": OP7, "op8_warc_bundles": OP8, "op10_suffix_array_dedup": OP10, "op11_spelling_variants": OP11}
