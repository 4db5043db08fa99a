"""The registered query of each operator, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import language, quality
from .common import crc_bucket, prepare
from .decontaminate import find_benchmark
from .fingerprint import edited_fingerprints, likeness, serialized
from .mixing import mix
from .packing import pack
from .prefix_trie import prefix_trie
from .simhash import near_duplicates
from .token_counts import count_tokens
from .token_files import token_index, write_tokens
from .url_rules import judge_urls
from .vector_codes import PARTS, ROUNDS, SCALE, ENTRIES, code_table
from .wrappers import extract_text

QUERIES: dict = {}
ORACLES: dict = {}
MAX_TOKENS = 512


def query(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = lambda spark, sf_dir: plan(prepare(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return plan

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1(spark, sf_dir):
    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


@query("op5_packing")
def op5(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).drop("ids", "curve_key")


@query("op10_token_files")
def op10(spark, sf_dir):
    return token_index(write_tokens(table(spark, sf_dir, "documents")))


@query("op2_near_duplicates")
def op2(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


# fixed values: the rules of the query as (host, path, verdict)
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""
WITH parts AS (
  SELECT page_id, strpos(url, '://') AS cut_at, url FROM pages
), cut AS (
  SELECT page_id, CASE WHEN cut_at > 0 THEN substr(url, cut_at + 3) ELSE '' END AS rest FROM parts
), named AS (
  SELECT page_id, {LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}
), hits AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS rn
  FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT n.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, rule, coalesce(v, 'allow') AS verdict
FROM named n LEFT JOIN hits h ON n.page_id = h.page_id AND rn = 1
"""


@query("op6_url_rules", OP6_SQL)
def op6(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP7_SQL = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), pattern AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
  FROM item, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s(i) WHERE len(w) > 0
), spot AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM doc, (SELECT DISTINCT n FROM pattern) AS sizes, unnest(generate_series(1, len(w) - n + 1)) AS s(i)
), hit AS (
  SELECT doc_id, i, spot.n, item_id FROM spot JOIN pattern ON spot.n = pattern.n AND spot.p = pattern.p
), word AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(generate_series(i, i + n - 1)) AS s(j) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op7_decontamination", OP7_SQL)
def op7(spark, sf_dir):
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op9_fingerprints")
def op9(spark, sf_dir):
    made = edited_fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        serialized(F.col("sketch")).alias("fingerprint"), serialized(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


@query("op8_language")
def op8(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = language.fit(language.training_rows(documents))
    return language.identify(documents, model).select(
        "doc_id", (crc_bucket("doc_id", language.BUCKETS) == language.HELD_OUT).alias("held_out"), "lang_pred", "score", "entropy")


@query("op4_quality")
def op4(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", (crc_bucket("doc_id", quality.BUCKETS) == quality.HELD_OUT).alias("held_out"), "score", "predicted")


@query("op3_main_text")
def op3(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


@query("op11_mixing")
def op11(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def _codes_sql(rounds: int = ROUNDS) -> str:
    """Reference SQL: components as rows, one assignment and one update a round."""
    width = f"(SELECT max(len(v)) // {PARTS} FROM kept)"

    def assigned(r: int) -> str:
        return f"""
), far{r} AS (
  SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d
  FROM comp c JOIN book{r} b ON c.part = b.part AND c.k = b.k GROUP BY ALL
), code{r} AS (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM far{r} GROUP BY vec_id, part"""

    sql = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comp AS (
  SELECT vec_id, i // {width} AS part, i % {width} AS k, v[i + 1] AS x
  FROM kept, unnest(generate_series(0, len(v) - 1)) AS s(i)
), seed AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}
), book0 AS (
  SELECT part, entry, k, x FROM comp JOIN seed USING (vec_id)"""
    for r in range(rounds):
        sql += assigned(r) + f"""
), mean{r} AS (
  SELECT c.part, e.entry, c.k, CAST(floor(CAST(sum(c.x) AS DOUBLE) / count(*)) AS BIGINT) AS x
  FROM comp c JOIN code{r} e USING (vec_id, part) GROUP BY ALL
), book{r + 1} AS (
  SELECT b.part, b.entry, b.k, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m USING (part, entry, k)"""
    return sql + assigned(rounds) + f"""
), line AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM code{rounds} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, k)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM line JOIN kept USING (vec_id), digest
"""


@query("op12_vector_codes", _codes_sql())
def op12(spark, sf_dir):
    return code_table(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body,
         md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'m': mark, 'b': strlen(body)} ORDER BY turn NULLS FIRST, mark) AS t FROM turns GROUP BY conv_id
), crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, CAST(0 AS BIGINT) AS i, CAST(4294967295 AS BIGINT) AS v FROM own
  UNION ALL
  SELECT conv_id, s, i + 1,
         CASE WHEN w % 2 = 1 THEN xor(w // 2, CAST(3988292384 AS BIGINT)) ELSE w // 2 END
  FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE v END AS w FROM crc WHERE i < 8 * length(s))
), take AS (
  SELECT conv_id, xor(v, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE i = 8 * length(s)
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(g.t, [])[1:h], o.t[h + 1:]) AS t
  FROM own o JOIN take USING (conv_id) LEFT JOIN own g ON g.conv_id = o.conv_id - o.conv_id % 5
), member AS (
  SELECT conv_id, d AS depth, md5(CAST(t[1:d] AS VARCHAR)) AS node, CASE WHEN d > 0 THEN md5(CAST(t[1:d - 1] AS VARCHAR)) END AS parent,
         CASE WHEN d > 0 THEN t[d].b ELSE 0 END AS bytes, len(t) = d AS at_end
  FROM rebuilt, unnest(generate_series(0, len(t))) AS s(d)
), node AS (
  SELECT node, depth, any_value(parent) AS parent, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256
  FROM member GROUP BY node, depth
), kids AS (
  SELECT parent AS node, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent
), under AS (
  SELECT DISTINCT a.node AS top, b.node FROM member a JOIN member b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), sums AS (
  SELECT top AS node, count(*) FILTER (k.node IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.bytes) AS BIGINT) AS saved_tokens
  FROM under u JOIN node n ON u.node = n.node LEFT JOIN kids k ON k.node = n.node GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM node n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN node p ON p.node = n.parent
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))
