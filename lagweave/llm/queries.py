"""The operators over the driver's tables: one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_start", "longest_item")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeats

    return repeats(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identified

    return identified(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeats

    return repeats(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_layout import rendered

    return rendered(table(spark, sf_dir, "pages"))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_binary import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk_search, op2_jaccard_join, op3_html_text, op4_decontamination, op5_packing, op6_toxicity, op7_substring_dedup, op8_language_id, op9_suffix_dedup, op10_token_binary)}


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.c, c.c) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.c) = len(c.c)
  WHERE q.vec_id % 20 = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM placed WHERE rank <= 20
"""


JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[s:s + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS s FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), reach(doc_id, other) AS (
  SELECT a, b FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1) r ON r.doc_id = d.doc_id
"""

CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS k, coalesce(CAST(item_id AS VARCHAR), 'null') AS item, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), test AS (
  SELECT k, item, m, s AS ts, array_to_string(w[s:s + m - 1], ' ') AS g FROM (SELECT k, item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)
), size AS (SELECT DISTINCT m FROM test
), win AS (
  SELECT r, m, s, array_to_string(w[s:s + m - 1], ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, size WHERE len(w) >= m)
), hit AS (
  SELECT r, s, win.m, item, k, ts FROM win JOIN test ON win.m = test.m AND win.g = test.g
), place AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM hit) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
), run AS (
  SELECT r, count(*) + max(m) - 1 AS n FROM (SELECT r, k, m, s - ts AS diagonal, s - row_number() OVER (PARTITION BY r, k, s - ts ORDER BY s) AS island FROM hit) GROUP BY r, k, diagonal, island
), most AS (SELECT r, max(n) AS longest FROM run GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN place ON d.r = place.r LEFT JOIN named ON d.r = named.r LEFT JOIN most ON d.r = most.r
"""

SUBSTRING_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)
), hit AS (
  SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM hit
), word AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d
), kept AS (
  SELECT word.r, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN x END, ' ' ORDER BY word.p) AS k
  FROM word LEFT JOIN gone ON word.r = gone.r AND word.p = gone.p GROUP BY word.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.r = kept.r
"""


SUFFIX_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), win AS (
  SELECT r, s, md5(substr(x, 2 * s - 1, 800)) AS h FROM (SELECT r, x, unnest(range(1, n - 398)) AS s FROM d WHERE n >= 400)
), hit AS (
  SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1
), span AS (
  SELECT r, min(s) AS a, max(s) + 400 AS b FROM (SELECT r, s, sum(opens) OVER (PARTITION BY r ORDER BY s) AS island FROM (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 400 THEN 0 ELSE 1 END AS opens FROM hit)) GROUP BY r, island
), kept AS (
  SELECT d.r, string_agg(substr(x, 2 * coalesce(lag_b, 1) - 1, 2 * (a - coalesce(lag_b, 1))), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM d JOIN (SELECT r, a, b, lag(b) OVER (PARTITION BY r ORDER BY a) AS lag_b FROM span) q ON d.r = q.r GROUP BY d.r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN x ELSE head || substr(x, 2 * last - 1) END)) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB over whole tables, where SQL can express the query."""
    return {"op1_topk_search": TOPK_SQL, "op2_jaccard_join": JACCARD_SQL, "op4_decontamination": CONTAMINATION_SQL, "op7_substring_dedup": SUBSTRING_SQL, "op9_suffix_dedup": SUFFIX_SQL}
