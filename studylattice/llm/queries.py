"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylattice.llm import (
    collocations,
    decontaminate,
    embed_dedup,
    infill,
    licenses,
    lm_score,
    near_dedup,
    packing,
    quality,
    repeats,
    toxicity,
    warc,
    wrappers,
)
from studylattice.llm.common import small_batches
from studylattice.session import allow_skewed_joins, fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        allow_skewed_joins(spark)
        small_batches(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query
def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.summaries(warc.read_archive(spark, folder))


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


@query
def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_notices(table(spark, sf_dir, "documents"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.aggregate("removed.length", F.lit(0).cast("long"), lambda total, n: total + n)
    return repeats.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        lengths.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# Words as every operator sees them: A-Z lower-cased, cut at space and tab to carriage return.
_WORDS = """list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"""

SQL["op1_benchmark_decontamination"] = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
docs AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
item_runs AS (SELECT DISTINCT item_id, least(5, len(w)) AS size,
    unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS run
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_runs),
doc_runs AS (SELECT DISTINCT r, doc_id, size,
    unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS run
  FROM docs, sizes WHERE len(w) >= size),
totals AS (SELECT item_id, count(*) AS n_item FROM item_runs GROUP BY item_id),
shared AS (SELECT r, doc_id, item_id, count(*) AS n_shared FROM item_runs JOIN doc_runs USING (size, run)
  GROUP BY r, doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN totals USING (item_id) WHERE 100 * n_shared >= 80 * n_item"""

# The smallest id reachable over links (a, b) held in both directions.
_REACHED = """reached AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, l.b FROM reached r JOIN both_ways l ON r.other = l.a),
lowest AS (SELECT node, min(other) AS low FROM reached GROUP BY node)"""

SQL["op7_minhash_near_dedup"] = f"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
runs AS MATERIALIZED (SELECT doc_id, hash(run) AS run FROM (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS run FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS s FROM runs x JOIN runs y USING (run)
  WHERE x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * s >= 80 * (p.n + q.n - s)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
{_REACHED}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON node = doc_id"""

SQL["op2_embedding_near_dedup"] = f"""
WITH RECURSIVE vectors AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm,
    row_number() OVER () AS r FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, x.r FROM vectors x JOIN vectors y
  ON x.label = y.label AND len(x.v) = len(y.v) AND x.r <> y.r AND x.norm > 0 AND y.norm > 0
  WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.93),
both_ways AS MATERIALIZED (SELECT DISTINCT a, b FROM links),
{_REACHED}
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
  coalesce(e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)), false) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = e.vec_id LEFT JOIN lowest ON node = e.vec_id"""

# 40 bits of a digest as eight base-32 digits.
_PART = "lpad(to_base(CAST('0x' || substr(d, {0}, 10) AS BIGINT), 32), 8, '0')"
SQL["op8_warc_archive"] = f"""
WITH records AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS d FROM pages),
firsts AS (SELECT payload, min(page_id) AS first_page FROM records GROUP BY payload)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
  translate({" || ".join(_PART.format(i) for i in (1, 11, 21, 31))}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_page THEN first_page END AS refers_to
FROM records JOIN firsts USING (payload)"""

SQL["op11_fill_in_middle"] = """
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM documents),
draws AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM units),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM draws),
pieces AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM pieces"""

SQL["op12_phrase_collocations"] = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
runs AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM runs GROUP BY lang),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM runs, (SELECT unnest(range(1, 5)) AS size) WHERE len(w) >= size),
phrases AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 30),
cuts AS (SELECT p.lang, p.size, p.phrase, p.f AS a, k, h.f AS l, t.f AS r, ((2000000::HUGEINT * p.f) // (h.f + t.f))::BIGINT AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM phrases WHERE size > 1) p
  JOIN phrases h ON h.lang = p.lang AND h.phrase = array_to_string(p.w[1:k], ' ')
  JOIN phrases t ON t.lang = p.lang AND t.phrase = array_to_string(p.w[k + 1:], ' ')),
candidates AS MATERIALIZED (SELECT lang, size, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN candidates b ON s.lang = b.lang AND s.size < b.size
  AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100::HUGEINT * b.a >= 80::HUGEINT * s.a),
ranked AS (SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
  FROM candidates c ANTI JOIN covered v ON v.lang = c.lang AND v.phrase = c.phrase)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

# Bytes as pairs of hexadecimal digits; runs are grouped by 128 bits of a digest.
SQL["op13_suffix_dedup"] = """
WITH docs AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
runs AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(x, 2 * p - 1, 200)) AS run FROM (SELECT doc_id, x, unnest(range(1, n_bytes - 98)) AS p FROM docs)),
later AS (SELECT doc_id, p FROM runs QUALIFY (doc_id, p) > min((doc_id, p)) OVER (PARTITION BY run)),
steps AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS fresh FROM later),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 99 AS z FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM steps) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM spans),
cut AS (SELECT doc_id, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last,
    string_agg(substr(x, 2 * y + 1, 2 * (a - y - 1)), '' ORDER BY a) AS kept FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)"""
