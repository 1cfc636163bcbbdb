"""The queries of this folder: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.llm import (
    decontaminate,
    html_text,
    license_scan,
    line_crf,
    near_duplicates,
    packing,
    phrases,
    quality_rules,
    surrogates,
    token_counts,
    token_files,
    warc_bundles,
    whitening,
)
from adjudica.session import new_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The key of the surrogates in queries; a production run passes a secret of its own.
SURROGATE_KEY = "example-key"
VOCABULARY = "byte_bpe_50k.json"


def _query(build):
    QUERIES[build.__name__] = build
    return build


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_documents(spark, sf_dir), vocabulary_path())
    return pieces.select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "placed",
    )


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(_documents(spark, sf_dir), benchmark).drop("key")


@_query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir))


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_documents(spark, sf_dir))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("row.doc_id", *[f"quality.{c}" for c in counts], "base_failed", "kept")


@_query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    token_files.write_token_files(_documents(spark, sf_dir), folder, vocabulary_path())
    return token_files.document_offsets(token_files.read_token_files(spark, folder))


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), vocabulary_path())


@_query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_documents(spark, sf_dir))


@_query
def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = surrogates.replace_personal_data(_documents(spark, sf_dir), SURROGATE_KEY)
    return replaced.select("row.doc_id", "text", "n_entities", "kinds")


@_query
def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_crf.score_documents(_documents(spark, sf_dir), labels)


@_query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_documents(spark, sf_dir))


@_query
def op12_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc_bundles.write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = warc_bundles.read_bundles(spark, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fit = whitening.fit_whitening(vectors, components=32)
    white = whitening.whiten(vectors, fit)
    shares = [float(share) for share in fit.explained] if fit else []
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(fit.n if fit else 0).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(F.lit(shares).cast("array<double>"), "at").alias("explained"),
        F.lit(fit.identity_error if fit else 0.0).alias("identity_error"),
    )


ORACLES["op2_decontamination"] = r"""WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0) t),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM split, (SELECT DISTINCT size FROM windows) s WHERE len(w) >= size) t),
found AS (SELECT p.doc_id, p.i, p.size, v.item FROM places p JOIN windows v ON p.size = v.size AND p.words = v.words),
hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) t GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256
  FROM found GROUP BY doc_id)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN hits h ON s.doc_id = h.doc_id LEFT JOIN named m ON s.doc_id = m.doc_id
"""

ORACLES["op12_warc_bundles"] = r"""WITH sizes AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
ranked AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM sizes),
digits AS (
  SELECT *, list_transform(range(32), lambda i: list_sum(list_transform(range(5), lambda b:
    CASE WHEN (CAST('0x' || sha[(5 * i + b) // 4 + 1] AS INTEGER) >> CAST(3 - (5 * i + b) % 4 AS INTEGER)) & 1 = 1
         THEN (1 << CAST(4 - b AS INTEGER)) ELSE 0 END))) AS code FROM ranked)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(code, lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(c AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM digits
"""

ORACLES["op11_phrases"] = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
numbered AS (SELECT lang, w, row_number() OVER () AS piece FROM split WHERE len(w) > 0),
tokens AS (SELECT lang, piece, unnest(w) AS x, unnest(range(len(w))) AS i FROM numbered),
followed AS (
  SELECT lang, x, lead(x) OVER places AS y, lead(x, 2) OVER places AS z FROM tokens
  WINDOW places AS (PARTITION BY piece ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, x AS phrase, count(*) AS f FROM followed GROUP BY ALL
  UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM followed WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM followed WHERE z IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2 AND f >= 10),
longer AS (
  SELECT lang, part, max(f) AS f FROM (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part, f FROM candidates WHERE k = 3) t
  GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f, cut, array_to_string(w[1 : cut], ' ') AS head, array_to_string(w[cut + 1 :], ' ') AS tail
  FROM candidates c, range(1, 3) t(cut) WHERE cut < c.k),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, cut,
         CAST((1000000 * CAST(c.f AS HUGEINT) * c.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.head JOIN grams y ON y.lang = c.lang AND y.phrase = c.tail
  LEFT JOIN longer o ON o.lang = c.lang AND o.part = c.phrase AND c.k = 2
  WHERE coalesce(100 * o.f < 50 * c.f, true)),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE rank <= 2000
"""
