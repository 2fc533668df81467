"""The queries opN_<name>: each operator with production parameters over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .centroids import centroid_clusters
from .decontaminate import decontaminate
from .line_dedup import line_dedup
from .maxent_lm import maxent_scores
from .mixing import Mix
from .quality_rules import quality_rules
from .sentencepieces import sentence_pieces
from .sharding import shard_plan
from .simhash import simhash_components
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .toxicity import toxicity
from .warc import warc_round_trip


#: Bytes a core below which a table is dealt over all cores first: small files can be a single row group, so one task.
SMALL = 4 << 20


def _read(spark, d, name):
    df = spark.read.parquet(f"{d}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < cores * SMALL else df


def _docs(spark, d):
    return _read(spark, d, "documents")


def _fold(key, n):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def _sha256(c):
    return F.sha2(F.col(c).cast("binary"), 256)


def op1_substring_dedup(spark, sf_dir):
    out = substring_dedup(_docs(spark, sf_dir), window=13)
    return out.select("doc_id", "n_words", "n_removed", _sha256("kept").alias("kept_sha256"))


def op2_warc(spark, sf_dir):
    return warc_round_trip(_read(spark, sf_dir, "pages"), least=0)


def op3_line_dedup(spark, sf_dir):
    out = line_dedup(_docs(spark, sf_dir), least=10)
    return out.select("doc_id", "n_lines", "n_dropped", _sha256("kept").alias("kept_sha256"))


def op4_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold("doc_id", 4) != 2)
    out = toxicity(_docs(spark, sf_dir), labels)
    return out.select("doc_id", F.coalesce(_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_quality_rules(spark, sf_dir):
    out = quality_rules(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_lm_scores(spark, sf_dir):
    out = maxent_scores(_docs(spark, sf_dir), _fold("doc_id", 7) != 2)
    return out.select("doc_id", F.coalesce(_fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_mixing(spark, sf_dir):
    return Mix(_docs(spark, sf_dir)).taken()


def op9_simhash(spark, sf_dir):
    out = simhash_components(_docs(spark, sf_dir), shingle=3, distance=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sharding(spark, sf_dir):
    out = shard_plan(_docs(spark, sf_dir), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_centroids(spark, sf_dir):
    out = centroid_clusters(_read(spark, sf_dir, "embeddings"), dim=64, k=8, rounds=10, scale=1024, seed=3)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", _sha256("centroid").alias("centroid_sha256"))


def op12_sentencepieces(spark, sf_dir):
    import public_tokenizers

    out = sentence_pieces(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), _sha256("decoded").alias("decoded_sha256"))


def op13_spelling(spark, sf_dir):
    return spelling_variants(_docs(spark, sf_dir), least=7, times=2, ratio=10)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_warc, op3_line_dedup, op4_toxicity, op5_decontaminate, op6_quality_rules, op7_lm_scores, op8_mixing, op9_simhash, op10_sharding, op11_centroids, op12_sentencepieces, op13_spelling)}

_SPACE = r"\x20\x09-\x0D"


#: CRC-32 by its polynomial, a table of the 256 bytes' remainders.
_CRC = [0] * 256
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ 0xEDB88320 * (_c & 1)
    _CRC[_i] = _c


def _crc32(text: str) -> str:
    bytes_ = f"list_transform(range(strlen({text})), lambda k: CAST('0x' || substr(hex({text}), CAST(2 * k + 1 AS INT), 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce({bytes_}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)))"


def _centroid_rounds(k: int, rounds: int) -> str:
    """Rounds of assignment (a) and new centroids (c), one pair of tables a round."""
    near = "SELECT vec_id, x, i, d FROM (SELECT v.vec_id, v.x, c.i, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, {c} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1"
    # the remainder is brought to 0 .. n - 1, as // cuts towards zero
    mean = "SELECT c.i, coalesce(m.x, c.x) AS x FROM {c} c LEFT JOIN (SELECT i, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM (SELECT i, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT i, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM {a}) GROUP BY i, j) GROUP BY i) m USING (i)"
    steps = [f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})" + (f",\nc{r + 1} AS MATERIALIZED ({mean.format(c=f'c{r}', a=f'a{r}')})" if r < rounds else "") for r in range(rounds + 1)]
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS i, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k}),
""" + ",\n".join(steps) + f"""
SELECT vec_id, CAST(i AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY i) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (i)"""


ORACLE = {
    "op13_spelling": rf"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS k, doc_id || ':' || run AS name FROM t GROUP BY ALL),
h AS (SELECT run, k, {_crc32("name")} AS h FROM g, (SELECT CAST({_CRC} AS BIGINT[]) AS crc)),
w AS MATERIALIZED (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.part = b.part AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.part = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.part = w.word),
b AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN best END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(root, step) AS root, n, n_near, form_n FROM f JOIN r USING (word) GROUP BY ALL""",
    "op11_centroids": _centroid_rounds(8, 10),
    "op1_substring_dedup": rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
m AS (SELECT s, min(doc_id) AS d FROM g GROUP BY s),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM (SELECT g.doc_id, g.i FROM g JOIN m USING (s) WHERE m.d < g.doc_id)),
r AS (SELECT doc_id, list(i) AS gone FROM h GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x)), lambda x: w[x]) END, ' ')) AS kept_sha256
FROM t LEFT JOIN r USING (doc_id)""",
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(s, CAST(5 * (k // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM d""",
    "op3_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, line, i, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS d FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, f.d IS NULL OR f.d = k.doc_id AS stays FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
}
