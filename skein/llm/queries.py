"""The queries of this subpackage, with production parameters over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import pii, quality
from skein.llm.chat import digests, format_conversations
from skein.llm.common import documents, id_crc32, tune
from skein.llm.langid import identify, train
from skein.llm.lines import line_dedup
from skein.llm.media import text_features
from skein.llm.middle import fill_in_middle, restored
from skein.llm.mixing import mix
from skein.llm.neardup import near_duplicates
from skein.llm.negatives import hard_negatives
from skein.llm.packing import pack_documents
from skein.llm.repeats import remove_repeats
from skein.llm.topk import integer_vectors, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


@query
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector whose id is divisible by 100 against all others: its ten largest integer inner products."""
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return topk(rows.where(F.col("id") % 100 == 0), rows, 10)


SQL["op1_topk"] = """
WITH e AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 100 = 0
), k AS (
  SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM k WHERE n <= 10
"""


@query
def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image of its bytes, read back, with digests and features."""
    out = text_features(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, sources weighing 3, 1, 2 in turn."""
    return mix(documents(spark, sf_dir), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


SQL["op9_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents
), s AS (
  SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT source, CAST(n AS BIGINT) AS n, CASE k % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS w FROM s
), f AS (
  SELECT a.source, a.n, a.w, 1.5 * (SELECT sum(n) FROM w) AS budget,
         coalesce((SELECT sum(2 * b.n) FROM w b WHERE b.n * a.w <= a.n * b.w), 0) AS capped,
         coalesce((SELECT sum(b.w) FROM w b WHERE b.n * a.w > a.n * b.w), 0) AS open_w
  FROM w a
), lim AS (
  SELECT *, 2 * n * (open_w + w) <= (budget - capped + 2 * n) * w AS stops FROM f
), g AS (
  SELECT (SELECT max(budget) FROM f) - coalesce(sum(2 * n) FILTER (WHERE stops), 0) AS rest_n, sum(w) FILTER (WHERE NOT stops) AS rest_w FROM lim
), t AS (
  SELECT source, n, CAST(CASE WHEN stops THEN 2 * n ELSE w * rest_n / rest_w END AS DOUBLE) AS target,
         CAST('0x' || substr(md5('0:' || coalesce('=' || source, '')), 1, 8) AS UBIGINT) / 4294967296.0 AS u
  FROM lim, g
), r AS (
  SELECT d.*, t.n, t.target, CASE WHEN t.n > 0 THEN t.target / t.n ELSE 0 END AS rate, t.u,
         row_number() OVER (PARTITION BY d.source ORDER BY length(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INTEGER), substr(o, 1, 1), size, o, doc_id) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target,
       CAST((floor(u + i * rate) - floor(u + (i - 1) * rate)) * size AS BIGINT) AS taken
FROM r
"""


@query
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of the labelled ones."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = id_crc32("doc_id") % 5 == 0
    model = train(docs, ~held_out)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from three quarters of the labels."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = id_crc32("doc_id") % 4 == 2
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 under the template, with what can be read back from the result."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(more), public_tokenizers.path("byte_bpe_50k.json")))


SQL["op7_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(16 + length(role) + length(text)
         + 2 * length(role || text) - length(replace(replace(role || text, '\', ''), '<', '')) - length(role || text)
         + 2 * length(role) - length(replace(replace(role, '>', ''), chr(10), '')) - length(role)) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digests(pii.find(documents(spark, sf_dir).select("doc_id", "text")))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    out = pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated 200-byte strings."""
    return remove_repeats(documents(spark, sf_dir))


SQL["op4_repeats"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), n AS (SELECT *, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
f AS MATERIALIZED (SELECT r, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS g FROM (SELECT r, h, unnest(range(0, n - 199)) AS i FROM n WHERE n >= 200)),
again AS (SELECT r, i FROM f SEMI JOIN (SELECT g FROM f GROUP BY g HAVING count(*) > 1) t USING (g)),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM again)) GROUP BY r, k),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_, lead(a) OVER (PARTITION BY r ORDER BY a) IS NULL AS last FROM runs),
kept AS (SELECT g.r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(n.h, CAST(2 * from_ + 1 AS BIGINT), CAST(2 * (a - from_) AS BIGINT)) || CASE WHEN last THEN substr(n.h, CAST(2 * b + 1 AS BIGINT)) ELSE '' END, '' ORDER BY a) AS h FROM gaps g JOIN n USING (r) GROUP BY g.r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256 FROM n LEFT JOIN kept USING (r)
"""


@query
def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, on two-word shingles."""
    return near_duplicates(documents(spark, sf_dir), shingle=2)


SQL["op2_neardup"] = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), x AS MATERIALIZED (
  SELECT r, CAST(len(s) AS BIGINT) AS n, unnest(s) AS g FROM s
), e AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.g = b.g AND a.r < b.r AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), z AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, z.b FROM reach JOIN z ON reach.b = z.a),
low AS (SELECT reach.a AS r, min(s.doc_id) AS low FROM reach JOIN s ON s.r = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, low AS component_id, doc_id IS NOT DISTINCT FROM low AS kept FROM s JOIN low USING (r)
"""


@query
def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two lines and put in fill-in-middle order, with digests of the result and of the text rebuilt from it."""
    out = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL["op13_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), k AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
         WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), c AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""


@query
def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a document of a smaller id holds too."""
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


SQL["op11_lines"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, string_split(coalesce(text, ''), chr(10)) AS u FROM documents),
l AS MATERIALIZED (
  SELECT r, o, line, i, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, o, unnest(u) AS line, generate_subscripts(u, 1) AS i FROM d)
), c AS (SELECT k, min(o) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT o) > 1),
m AS (SELECT l.r, l.i, l.line, c.k IS NOT NULL AND l.o <> c.owner AS gone FROM l LEFT JOIN c ON l.k = c.k),
t AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN t USING (r)
"""


@query
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each anchor and each of its five best rows of one label, the best rows of other labels that score from 80 % of it up to it; a seventh of the labels is moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.struct("vec_id", moved.alias("label")).alias("told"), "vec_id", "embedding")
    rows = integer_vectors(raw.where("told.label is not null"), "vec_id", "embedding", 256, ["told"])
    return hard_negatives(rows.select("id", "told.label", "v"), F.col("id") % 100 == 0)


SQL["op12_negatives"] = """
WITH e AS (
  SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT q.vec_id AS anchor_id, q.r AS qr, c.vec_id, c.r, q.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS n FROM s WHERE same) WHERE n <= 5
), k AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.qr, p.n ORDER BY s.score DESC, s.vec_id, s.r) AS rank
  FROM p JOIN s ON p.qr = s.qr AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM k WHERE rank <= 5
"""
