"""Queries of the operators in this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm import html_text, quality
from fabula.llm.decontaminate import contaminations
from fabula.llm.media import media_features, texts_to_media
from fabula.llm.minhash import near_duplicates
from fabula.llm.sentencepiece_wfst import encode
from fabula.llm.sharding import kd_shards
from fabula.llm.substring_dedup import substring_dedup
from fabula.llm.suffix_dedup import suffix_dedup
from fabula.llm.url_filters import SOFT, STRICT, Rule, url_filter


#: Where the tokenizer's model file is; a parameter of the operator.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS content
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words)
), first AS (
  SELECT content, min(doc_id) AS least FROM windows GROUP BY content
), hit AS (
  SELECT doc_id, s FROM windows JOIN first USING (content) WHERE least < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS places
  FROM (SELECT doc_id, unnest(range(s, s + 13)) AS p FROM hit) GROUP BY doc_id
), kept AS (
  SELECT doc_id, w, coalesce(places, []) AS places FROM words LEFT JOIN gone USING (doc_id)
), flat AS (
  SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words)
), stay AS (
  SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.p) AS text
  FROM flat f ANTI JOIN (SELECT doc_id, unnest(places) AS p FROM gone) g ON f.doc_id = g.doc_id AND f.p = g.p
  GROUP BY f.doc_id
)
SELECT k.doc_id, CAST(len(k.w) AS BIGINT) AS n_words, CAST(len(k.places) AS BIGINT) AS n_removed,
       sha256(coalesce(s.text, '')) AS kept_sha256
FROM kept k LEFT JOIN stay s ON k.doc_id = s.doc_id
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), rules=URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _hits(terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INT)" for t in terms)


_OP3_SQL = rf"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, url, coalesce(rest, '') AS rest FROM rest)
), rules(v, h, p) AS (
  VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}
), fitted AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, f.rule,
       coalesce(f.v, CASE WHEN {_hits(STRICT)} >= 1 OR {_hits(SOFT)} >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts s LEFT JOIN fitted f ON s.page_id = f.page_id
"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


_OP4_SQL = r"""
WITH hexed AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, s, array_slice(h, 2 * s + 1, 2 * s + 100) AS content
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS s FROM hexed)
), first AS (
  SELECT content, min(doc_id) AS least FROM windows GROUP BY content
), hit AS (
  SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50, true) AS new
  FROM windows JOIN first USING (content) WHERE least < doc_id
), spans AS (
  SELECT doc_id, nth, min(s) AS a, max(s) + 50 AS b
  FROM (SELECT doc_id, s, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS nth FROM hit) GROUP BY doc_id, nth
), pieces AS (
  SELECT doc_id, a, b, array_slice(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * a) AS before,
         h FROM spans JOIN hexed USING (doc_id)
), cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(before, '' ORDER BY a) || array_slice(any_value(h), 2 * max(b) + 1, length(any_value(h))) AS kept
  FROM pieces GROUP BY doc_id
)
SELECT x.doc_id, CAST(length(x.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(c.kept, x.h))) AS kept_sha256
FROM hexed x LEFT JOIN cut c ON x.doc_id = c.doc_id
"""


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, similarity=(85, 100))


_OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS s FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), both_have AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT p.a, p.b FROM both_have p JOIN sizes x ON p.a = x.doc_id JOIN sizes y ON p.b = y.doc_id
  WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN component c ON d.doc_id = c.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality.fit(documents, _table(spark, sf_dir, "labels").where(~quality.held_out()))
    scored = quality.score(documents, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media_features(texts_to_media(_table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"), TOKENIZER, check=True)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_OP9_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), doc_shingles AS (
  SELECT doc_id, len(w) - 4 AS size, s - 1 AS at, array_to_string(w[s:s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM doc_words)
), item_counts AS (
  SELECT item_id, n, g, count(*) AS c
  FROM (SELECT item_id, len(w) - 4 AS n, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS s FROM item_words))
  GROUP BY item_id, n, g
), pairs AS (
  SELECT doc_id, item_id, n, size FROM (
    SELECT d.doc_id, i.item_id, i.n, d.size, least(count(*), any_value(i.c)) AS common
    FROM doc_shingles d JOIN item_counts i USING (g) GROUP BY d.doc_id, i.item_id, i.n, d.size, g)
  GROUP BY doc_id, item_id, n, size HAVING sum(common) >= 0.8 * n
), windows AS (
  SELECT doc_id, item_id, n, size, unnest(range(0, greatest(size - n, 0) + 1)) AS start_word FROM pairs
), shared AS (
  SELECT w.doc_id, w.item_id, w.n, w.size, w.start_word, least(count(*), any_value(i.c)) AS common
  FROM windows w JOIN doc_shingles d ON d.doc_id = w.doc_id AND d.at >= w.start_word AND d.at < w.start_word + w.n
  JOIN item_counts i ON i.item_id = w.item_id AND i.g = d.g
  GROUP BY w.doc_id, w.item_id, w.n, w.size, w.start_word, i.g
), alike AS (
  SELECT doc_id, item_id, start_word, sum(common) / (least(n, size) + n - sum(common)) AS similarity
  FROM shared GROUP BY doc_id, item_id, n, size, start_word
)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(start_word, (-similarity, start_word)) AS INT) AS start_word
FROM alike WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_sharding": op2_sharding,
        "op3_url_filters": op3_url_filters,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality": op5_quality,
        "op6_media": op6_media,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_html_text": op8_html_text,
        "op9_decontaminate": op9_decontaminate,
        "op10_minhash": op10_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1_SQL, "op3_url_filters": _OP3_SQL, "op4_suffix_dedup": _OP4_SQL, "op9_decontaminate": _OP9_SQL, "op10_minhash": _OP10_SQL}
