"""Queries on texts: chunks, quality, names, retrieval and extraction.

The local texts are Latin pseudo-words, so the keyword lists are given as parameters.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import numbers as N
from ..functions import text as T
from ..functions.codes import file_metadata, normalize_code
from ..lexicon import DEFAULT
from ..operators import attribution as AT
from ..operators import chunking as CH
from ..operators import companies as C
from ..operators import extraction as X
from ..operators import matching as M
from ..operators import resolution as RES
from ..operators import retrieval as RT
from ..scale import global_row_number
from ..session import written
from ..sources import tables as TB
from . import sql as S
from .driver_tables import YEAR_SHIFT, cents, money, read
from .registry import query
from .statement_queries import company_master, sup

CAUSE, INDUSTRY, PRODUCT, BONUS = ("tion", "ment", "keit"), ("nicht", "einach"), ("und",), ("sich", "lich")
STOP = ("the", "und", "le", "la")
LOCAL = DEFAULT.but(
    cause=CAUSE, industry=INDUSTRY, product=PRODUCT, stop_words=STOP, research_word="elle",
    industry_bonus=BONUS, industry_sentence=("nicht", "sich"), metrics=(), company_fields=(),
)


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query("document_chunks", "WITH " + S.CHUNKS + "SELECT doc_id, chunk_index, length(text) AS n_chars, md5(text) AS digest FROM chunks")
def document_chunks(spark, d):
    out = CH.explode_chunks(read(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "chunk_index", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("profile_chunks", """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code, 'company_profile' AS source_type, 0 AS chunk_index,
  s_name || '（' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '），公司全称为Company ' || substring(s_name, 10, 9) || '。所属行业：' || n_name ||
  '。上市交易所：。注册资本：' || CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '。员工人数：。管理人员人数：。' AS text
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def profile_chunks(spark, d):
    blank = F.lit("")
    master = company_master(spark, d).select("*", blank.alias("listed_exchange"), blank.alias("employee_count"), blank.alias("management_count"))
    return CH.profile_chunks(master).select("stock_code", "source_type", "chunk_index", "text")


@query("research_meta_chunks", """
SELECT 'stock_research_meta' AS source_type, source AS stock_code,
  '个股研报标题：doc ' || doc_id || '。股票：' || lang || '（' || source || '）。机构：org。发布日期：' || n_chars || '。评级：。研究员：。' AS text FROM documents
UNION ALL SELECT 'industry_research_meta', '', '行业研报标题：page ' || page_id || '。行业：web。机构：org。发布日期：1。评级：。研究员：。' FROM pages""")
def research_meta_chunks(spark, d):
    stock = read(spark, d, "documents").select(
        F.concat(F.lit("doc "), "doc_id").alias("title"), F.col("lang").alias("stockName"), F.col("source").alias("stockCode"),
        F.lit("org").alias("orgName"), F.col("n_chars").cast("string").alias("publishDate"), F.lit("").alias("emRatingName"), F.lit("").alias("researcher"))
    industry = read(spark, d, "pages").select(
        F.concat(F.lit("page "), "page_id").alias("title"), F.lit("web").alias("industryName"), F.lit("org").alias("orgName"),
        F.lit("1").alias("publishDate"), F.lit("").alias("emRatingName"), F.lit("").alias("researcher"))
    return CH.research_meta_chunks(stock, industry).select("source_type", "stock_code", "text")


@query("research_routing", """
SELECT page_id, CASE WHEN EXISTS (SELECT 1 FROM documents WHERE doc_id = page_id AND lang = 'en') THEN 'stock_research_pdf'
  WHEN EXISTS (SELECT 1 FROM benchmark WHERE item_id = page_id) THEN 'industry_research_pdf' ELSE 'research_pdf' END AS source_type,
  coalesce((SELECT source FROM documents WHERE doc_id = page_id AND lang = 'en'), '') AS stock_name FROM pages""")
def research_routing(spark, d):
    files = read(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("title"))
    stock = read(spark, d, "documents").filter(F.col("lang") == "en").select(
        F.col("doc_id").cast("string").alias("title"), F.col("doc_id").cast("string").alias("stockCode"), F.col("source").alias("stockName"))
    industry = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("title"))
    return C.route_research(files, stock, industry).select("page_id", "source_type", "stock_name")


SQ_T, SQ_H = S.squeeze("text"), S.squeeze("html")
VISIBLE = r"regexp_replace({0}, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', '', 'g')"
BAD = r"length(regexp_replace({0}, '[!-~\x{{4e00}}-\x{{9fff}}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}]', '', 'g'))"
NOT_CJK = r"length(regexp_replace({0}, '[\x{{4e00}}-\x{{9fff}}]', '', 'g'))"


def ratio_sql(column: str) -> str:
    v = VISIBLE.format(column)
    return f"CASE WHEN length({v}) = 0 THEN 1.0 ELSE {BAD.format(v)} / length({v}) END"


@query("text_quality", f"""
WITH t AS (SELECT 'documents' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages),
v AS (SELECT kind, id, text, {VISIBLE.format('text')} AS v FROM t),
r AS (SELECT *, CASE WHEN length(v) = 0 THEN 1.0 ELSE {BAD.format('v')} / length(v) END AS r FROM v)
SELECT kind, id, round(r, 6) AS bad_ratio, length(v) > 0 AND r > 0.12 AS encoding_issue, length(v) = 0 OR r > 0.25 AS noisy,
  CASE WHEN length(v) = 0 THEN 0.0 ELSE round((length(v) - {NOT_CJK.format('v')}) / length(v), 6) END AS cjk_ratio FROM r""")
def text_quality(spark, d):
    rows = read(spark, d, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        read(spark, d, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    t = F.col("text")
    return rows.select(
        "kind", "id", F.round(T.bad_text_ratio(t), 6).alias("bad_ratio"), T.has_encoding_issue(t).alias("encoding_issue"),
        T.is_noisy(t).alias("noisy"), F.round(T.cjk_ratio(t), 6).alias("cjk_ratio"))


def clip_sql(column: str, n: int) -> str:
    return f"substring({S.squeeze('translate(' + S.squeeze(column) + chr(44) + chr(39) + 'îïìðñò' + chr(39) + chr(44) + chr(39) + ' ' * 6 + chr(39) + ')')}, 1, {n})"


CLEAN_SENTENCE = f"""length(c) >= 8 AND length(c) - length(replace(c, chr(92), '')) < 3 AND {ratio_sql('c')} <= 0.10
  AND regexp_matches(c, '[\\p{{L}}]')"""
SPLIT = "unnest(regexp_extract_all({0}, '[^。！？；!?;\\n]*(?:[。！？；!?;\\n]|$)'))"


@query("evidence_sentences", f"""
WITH s AS (SELECT doc_id, {S.squeeze('x')} AS s FROM (SELECT doc_id, {SPLIT.format('text')} AS x FROM documents)),
c AS (SELECT doc_id, s, {clip_sql('s', 400)} AS c, {clip_sql('s', 120)} AS k FROM s WHERE s <> ''),
f AS (SELECT doc_id, {CLEAN_SENTENCE} AS clean,
  length(k) >= 12 AND {ratio_sql('k')} <= 0.08 AND (length(k) - length(regexp_replace(k, '[0-9]', '', 'g'))) / greatest(length(k), 1) <= 0.55 AS quotable, length(k) AS n FROM c)
SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (clean) AS n_clean, count(*) FILTER (quotable) AS n_quotable, CAST(sum(n) FILTER (quotable) AS BIGINT) AS quoted_chars FROM f GROUP BY 1""")
def evidence_sentences(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.explode(T.split_sentences(F.col("text"))).alias("s"))
    s = s.select("doc_id", T.is_clean_sentence(F.col("s")).alias("clean"), T.reference_snippet(F.col("s")).alias("k"))
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.count_if("clean").alias("n_clean"),
        F.count("k").alias("n_quotable"), F.sum(F.length("k")).alias("quoted_chars"))


THEMES = (("growth", ("tion", "ment")), ("quality", ("lich", "keit")), ("trade", ("ble", "oue")))


@query("theme_first_sentence", "WITH " + S.CHUNKS + f""",
s AS (SELECT source, doc_id, chunk_index, {S.squeeze('x')} AS s, i FROM (
  SELECT source, doc_id, chunk_index, {SPLIT.format('text')} AS x, generate_subscripts(regexp_extract_all(text, '[^。！？；!?;\\n]*(?:[。！？；!?;\\n]|$)'), 1) AS i FROM chunks)),
c AS (SELECT *, {clip_sql('s', 400)} AS c FROM s WHERE s <> ''),
g AS (SELECT * FROM c WHERE {CLEAN_SENTENCE}),
h AS ({' UNION ALL '.join(f"SELECT {i} AS theme_order, '{n}' AS theme, * FROM g WHERE {any_of('s', w)}" for i, (n, w) in enumerate(THEMES))})
SELECT source, theme_order, theme, substring(s, 1, 180) AS sentence, 'documents/' || doc_id AS paper_path FROM h
QUALIFY row_number() OVER (PARTITION BY source, theme_order ORDER BY 'documents/' || doc_id, chunk_index, i) = 1""")
def theme_first_sentence(spark, d):
    docs = read(spark, d, "documents").select(
        "source", F.lit("").alias("title"), F.concat(F.lit("documents/"), "doc_id").alias("file_path"), F.lit("stock_research_pdf").alias("source_type"), "text")
    return RT.theme_sentences(CH.explode_chunks(docs), THEMES, keys=("source",), least_cjk=0.0, longest=fv.THEME_SENTENCE)


@query("number_tokens", r"""
WITH n AS (SELECT page_id, regexp_extract_all(html, '不适用|-?[0-9,]+(?:\.[0-9]+)?%?') AS t FROM pages)
SELECT page_id, len(t) AS n_tokens, array_to_string(t[1:8], ' ') AS first_tokens FROM n""")
def number_tokens(spark, d):
    t = X.raw_numbers(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(F.slice(t, 1, 8), " ").alias("first_tokens"))


@query("glued_numbers", """
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' ' || CAST(CAST(o_totalprice * 2 AS DECIMAL(18,2)) AS VARCHAR) || ' 2024年' AS cleaned FROM orders""")
def glued_numbers(spark, d):
    a, b = money("o_totalprice"), (F.col("o_totalprice") * 2).cast("decimal(18,2)")
    glued = F.concat(a.cast("string"), b.cast("string"), F.lit("2024年"))
    return read(spark, d, "orders").select("o_orderkey", T.clean_extracted(glued).alias("cleaned"))


@query("number_parsing", """
SELECT l_orderkey, l_linenumber, l_extendedprice * CASE l_linenumber % 4 WHEN 1 THEN 10000 WHEN 2 THEN 100000000 ELSE 1 END AS value,
  CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE abs(l_extendedprice) END AS plain FROM lineitem""")
def number_parsing(spark, d):
    k = F.col("l_linenumber") % 4
    shown = F.format_number(F.col("l_extendedprice"), 2)
    text = F.concat(shown, F.when(k == 1, "万").when(k == 2, "亿").when(k == 3, "%").otherwise("元"))
    plain = F.when(k == 3, F.concat(shown, F.lit("d"))).otherwise(shown)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.to_float(text).alias("value"), N.to_float(plain).alias("plain"))


@query("file_metadata", """
SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS stock_code, strftime(o_orderdate, '%Y-%m-%d') AS report_date,
  CAST(year(o_orderdate) + 20 AS VARCHAR) || CASE quarter(o_orderdate) WHEN 1 THEN 'Q1' WHEN 2 THEN 'HY' WHEN 3 THEN 'Q3' ELSE 'FY' END AS report_period FROM orders""")
def file_meta(spark, d):
    q = F.quarter("o_orderdate")
    kind = F.when(q == 1, "第一季度报告").when(q == 2, "半年度报告").when(q == 3, "第三季度报告").otherwise("年度报告")
    stem = F.concat(F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"))
    text = F.concat((F.year("o_orderdate") + YEAR_SHIFT).cast("string"), F.lit(" 年 "), kind)
    m = file_metadata(stem, text)
    return read(spark, d, "orders").select("o_orderkey", m["stock_code"].alias("stock_code"), m["report_date"].alias("report_date"), m["report_period"].alias("report_period"))


# --- names in texts ----------------------------------------------------------------------

NAMES = r"""
names AS (SELECT item_id, regexp_extract(text, '^(\S+ \S+)', 1) AS alias FROM benchmark UNION ALL SELECT item_id, regexp_extract(text, '^(\S+)', 1) FROM benchmark),
al AS (SELECT alias, max(lpad(CAST(item_id AS VARCHAR), 6, '0')) AS stock_code FROM names WHERE alias <> '' GROUP BY alias)
"""


def _names(spark, d):
    b = read(spark, d, "benchmark")
    both = F.explode(F.array(F.regexp_extract("text", r"^(\S+ \S+)", 1), F.regexp_extract("text", r"^(\S+)", 1)))
    return b.select(F.lpad(F.col("item_id").cast("string"), 6, "0").alias("stock_code"), both.alias("alias")).filter(
        F.col("alias") != "").groupBy("alias").agg(F.max("stock_code").alias("stock_code"))


@query("longest_alias_match", "WITH " + NAMES + """
SELECT doc_id, alias, stock_code FROM documents JOIN al ON contains(text, alias)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(alias) DESC, alias DESC) = 1""")
def longest_alias_match(spark, d):
    return M.best_company(read(spark, d, "documents"), ["doc_id"], "text", _names(spark, d).withColumn("tier", F.lit(1)))


@query("alias_occurrences", "WITH " + NAMES + "SELECT alias, count(*) AS n_documents FROM documents JOIN al ON contains(text, alias) GROUP BY 1")
def alias_occurrences(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    return M.contains_match(docs, ["doc_id"], "text", _names(spark, d), "alias").groupBy("alias").agg(F.count(F.lit(1)).alias("n_documents"))


@query("alias_occurrences_by_gram", "WITH " + NAMES + "SELECT alias, count(*) AS n_messages FROM conversations JOIN al ON contains(text, alias) GROUP BY 1")
def alias_occurrences_by_gram(spark, d):
    turns = read(spark, d, "conversations").select("conv_id", "turn", "text")
    return M.gram_match(turns, ["conv_id", "turn"], "text", _names(spark, d), "alias").groupBy("alias").agg(F.count(F.lit(1)).alias("n_messages"))


@query("company_tags", """
WITH t AS (SELECT p_partkey, p_name FROM part), n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part)
SELECT p_partkey, string_agg(w, ',' ORDER BY w) AS tags FROM t JOIN n ON contains(p_name, w) GROUP BY 1""")
def company_tags(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_name")
    names = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("stock_abbr")).distinct().select(
        F.col("stock_abbr").alias("stock_code"), "stock_abbr", F.lit("").alias("company_name"))
    out = M.company_tags(part, ["p_partkey"], "p_name", names)
    return out.select("p_partkey", F.array_join("company_tags", ",").alias("tags"))


@query("unique_fragments", """
WITH n AS (SELECT s_suppkey AS code, s_name AS n FROM supplier UNION ALL SELECT p_partkey + 1000000, p_name FROM part),
f AS (SELECT code, substring(n, 1, k) AS fragment FROM n, range(2, 6) r(k) WHERE length(n) >= k
  UNION SELECT code, right(n, CAST(k AS INTEGER)) FROM n, range(2, 6) r(k) WHERE length(n) >= k)
SELECT fragment, min(code) AS code FROM f GROUP BY 1 HAVING count(DISTINCT code) = 1""")
def unique_fragments(spark, d):
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("stock_code"), F.col("s_name").alias("stock_abbr")).unionByName(
        read(spark, d, "part").select((F.col("p_partkey") + 1000000).alias("stock_code"), F.col("p_name").alias("stock_abbr")))
    out = M.fragment_names(rows.withColumn("company_name", F.lit("")), generic=(), legal=(), blockers=())
    return out.withColumnRenamed("stock_code", "code")


@query("reference_lookup", r"""
WITH r AS (SELECT page_id AS request_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_extract(url, '([^/]+)$', 1) END AS ref FROM pages),
e AS (SELECT DISTINCT ref, p.page_id AS chunk_id, 'exact' AS match FROM r JOIN pages p ON p.url = ref),
m AS (SELECT * FROM e UNION ALL SELECT DISTINCT ref, p.page_id, 'contains' FROM r JOIN pages p ON contains(p.url, ref) WHERE ref <> '' AND ref NOT IN (SELECT ref FROM e))
SELECT request_id, chunk_id, match FROM r JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY ref ORDER BY chunk_id) <= 12) USING (ref)""")
def reference_lookup(spark, d):
    pages = read(spark, d, "pages")
    ref = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_extract("url", "([^/]+)$", 1))
    requests = pages.select(F.col("page_id").alias("request_id"), ref.alias("reference"))
    chunks = pages.select(F.col("page_id").alias("chunk_id"), F.col("url").alias("file_path"), F.lit("page").alias("title"))
    return TB.reference_matches(requests, chunks).select("request_id", "chunk_id", "match")


# --- retrieval ---------------------------------------------------------------------------

WORD = r"[A-Za-z0-9_.%-]+"


@query("token_overlap", f"""
WITH a AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations),
k AS (SELECT *, [lower(x) for x in regexp_extract_all(q, '[一-鿿]+|{WORD}')] AS qt, [lower(x) for x in regexp_extract_all(t, '[一-鿿]+|{WORD}')] AS tt FROM a WHERE t IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(qt) = 0 OR len(tt) = 0 THEN CAST(0 AS DOUBLE) ELSE len([x for x in qt if list_contains(tt, x)]) + CASE WHEN contains({S.squeeze('t')}, {S.squeeze('q')}) THEN CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS score FROM k""")
def token_overlap(spark, d):
    turns = read(spark, d, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", T.score_text(F.col("text"), F.col("t")).alias("score"))


KINDS = ("stock_research_pdf", "stock_research_meta", "financial_report_pdf", "industry_research_pdf", "industry_research_meta")


def retrieval_chunks(spark, d):
    docs = read(spark, d, "documents")
    k = F.col("doc_id")
    rows = docs.select(
        "doc_id", F.get(F.array(*[F.lit(x) for x in KINDS]), (k % 5).cast("int")).alias("source_type"),
        F.concat_ws(" ", "source", "lang").alias("title"), F.lpad((k % 50).cast("string"), 6, "0").alias("stock_code"),
        F.concat(F.lit("name"), (k % 70).cast("string")).alias("stock_name"), F.concat((2015 + k % 7).cast("string"), F.lit("FY")).alias("report_period"),
        F.concat(F.lit("documents/"), k.cast("string")).alias("file_path"), "text")
    return CH.explode_chunks(rows).withColumn("chunk_id", F.col("doc_id") * 100000 + F.col("chunk_index")).drop("doc_id")


def retrieval_requests(spark, d):
    turns = read(spark, d, "conversations").filter(F.col("role") == "user")
    k = F.col("conv_id")
    known = k % 4 == 0
    return turns.select(
        (k * 1000 + F.col("turn")).alias("request_id"), F.col("text").alias("question"), (k % 3 == 0).alias("prefer_causes"),
        F.when(known, F.lpad((k % 50).cast("string"), 6, "0")).alias("stock_code"),
        F.when(known, F.concat(F.lit("name"), (k % 70).cast("string"))).alias("stock_abbr"),
        F.when(known, F.concat(F.lit("name"), ((k + 1) % 70).cast("string"))).alias("company_name"))


def _case(column: str, order) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{n}' THEN {i}" for n, i in order) + " ELSE 9 END"


def _in(column: str, names) -> str:
    return f"{column} IN (" + ", ".join(f"'{n}'" for n in names) + ")"


TURN_REQUESTS = """SELECT conv_id * 1000 + turn AS request_id, text AS question, conv_id % 3 = 0 AS prefer,
    CASE WHEN conv_id % 4 = 0 THEN lpad(CAST(conv_id % 50 AS VARCHAR), 6, '0') END AS code, CASE WHEN conv_id % 4 = 0 THEN 'name' || (conv_id % 70) END AS abbr,
    CASE WHEN conv_id % 4 = 0 THEN 'name' || ((conv_id + 1) % 70) END AS name FROM conversations WHERE role = 'user'"""
TURN_WORDS = f"regexp_extract_all({S.squeeze('question')}, '[一-鿿]{{2,8}}|{WORD}')"


def _retrieval_sql(requests: str, words: str) -> str:
    """Ranked chunks ``ra`` of the requests: a WITH list to go on from."""
    hits = "(" + " + ".join(f"CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END" for w in CAUSE) + ")"
    dbl = lambda x: f"CAST({x} AS DOUBLE)"
    terms = f"""[lower(w) for w in list_concat({words},
        CASE WHEN code IS NULL THEN CAST([] AS VARCHAR[]) ELSE [abbr, name, code] END)]"""
    stop = ", ".join(f"'{w}'" for w in STOP)
    return f"""WITH {S.CHUNKS},
ch AS (SELECT doc_id * 100000 + chunk_index AS chunk_id, chunk_index, text, source || ' ' || lang AS title,
    [{', '.join(f"'{k}'" for k in KINDS)}][doc_id % 5 + 1] AS kind, lpad(CAST(doc_id % 50 AS VARCHAR), 6, '0') AS c_code, 'name' || (doc_id % 70) AS c_name,
    CAST(2015 + doc_id % 7 AS VARCHAR) || 'FY' AS period, 'documents/' || doc_id AS path FROM chunks),
rq0 AS ({requests}),
rq1 AS (SELECT *, {VISIBLE.format('question')} AS compact, {terms} AS raw FROM rq0),
rq2 AS (SELECT *, {any_of('compact', INDUSTRY)} AS industry, {any_of('compact', INDUSTRY)} AND {any_of('compact', PRODUCT)} AS product, contains(compact, 'elle') AS research,
    [w for w in raw if length(w) >= 2 AND w NOT IN ({stop}) AND NOT (regexp_matches(w, '^[0-9]+$') AND length(w) < 4)] AS useful FROM rq1),
rq AS (SELECT *, list_filter(useful, lambda w, i: list_position(useful, w) = i)[1:6] AS terms, [lower(x) for x in regexp_extract_all(question, '[一-鿿]+|{WORD}')] AS qt,
    CASE WHEN code IS NOT NULL THEN 600 WHEN industry OR prefer THEN 400 ELSE 300 END AS lim FROM rq2),
tm AS (SELECT request_id, CASE WHEN len(terms) = 0 THEN '' ELSE unnest(terms) END AS term FROM rq UNION ALL SELECT request_id, '' FROM rq WHERE len(terms) = 0),
dt AS (SELECT DISTINCT term FROM tm),
po AS (SELECT term, chunk_id FROM dt JOIN ch ON term = '' OR contains(lower(title), term) OR contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), term)),
pr AS (SELECT DISTINCT request_id, chunk_id FROM tm JOIN po USING (term)),
ca AS (SELECT rq.*, ch.* FROM pr JOIN rq USING (request_id) JOIN ch USING (chunk_id)
  WHERE (code IS NULL OR c_code = code OR c_name IN (abbr, name))
    AND CASE WHEN product THEN {_in('kind', fv.SOURCE_WHITELIST['product'])} WHEN industry THEN {_in('kind', fv.SOURCE_WHITELIST['industry'])}
      WHEN prefer THEN {_in('kind', fv.SOURCE_WHITELIST['cause'])} WHEN research THEN {_in('kind', fv.SOURCE_WHITELIST['research'])} ELSE true END
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY {_case('kind', fv.CANDIDATE_ORDER)}, period DESC, chunk_index, chunk_id) <= lim),
cb AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {_case('kind', fv.CANDIDATE_ORDER)}, period DESC, chunk_index, chunk_id) AS cr,
    title || ' ' || text AS whole FROM ca),
cc AS (SELECT *, [lower(x) for x in regexp_extract_all(whole, '[一-鿿]+|{WORD}')] AS tt, len([t for t in terms if contains(whole, t)]) AS th, {hits} AS hits FROM cb
  WHERE NOT ({_in('kind', fv.EXTRACTED_SOURCES)} AND {ratio_sql('text')} > 0.22)),
sc AS (SELECT *, CASE WHEN len(qt) = 0 OR len(tt) = 0 THEN {dbl(0)} ELSE len([x for x in qt if list_contains(tt, x)]) + CASE WHEN contains({S.squeeze('whole')}, {S.squeeze('question')}) THEN {dbl(2)} ELSE {dbl(0)} END END
    + least(th, 4) * {dbl(1.2)} + CASE WHEN c_code = code THEN {dbl(5)} WHEN c_name IN (abbr, name) THEN {dbl(3)} ELSE {dbl(0)} END
    + CASE WHEN industry AND kind IN ('industry_research_meta', 'industry_research_pdf') THEN {dbl(4)} ELSE {dbl(0)} END
    - CASE WHEN industry AND kind = 'financial_report_pdf' THEN {dbl(3)} ELSE {dbl(0)} END
    - CASE WHEN product AND kind = 'financial_report_pdf' THEN {dbl(4)} ELSE {dbl(0)} END
    + CASE WHEN industry AND {any_of('text', BONUS)} THEN {dbl(3)} ELSE {dbl(0)} END
    + CASE WHEN research AND contains(kind, 'research') THEN {dbl(2)} ELSE {dbl(0)} END
    + CASE WHEN prefer AND kind IN ('stock_research_pdf', 'stock_research_meta') THEN {dbl(3)} ELSE {dbl(0)} END
    - CASE WHEN prefer AND kind = 'financial_report_pdf' THEN {dbl(1)} ELSE {dbl(0)} END
    + CASE WHEN prefer THEN CASE WHEN hits > 0 THEN least(hits, 2) * {dbl(1.5)} ELSE {dbl(-2)} END ELSE {dbl(0)} END AS score FROM cc),
ra AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC,
    CASE WHEN industry THEN {_case('kind', fv.RESULT_ORDER['industry'])} WHEN prefer THEN {_case('kind', fv.RESULT_ORDER['cause'])} ELSE {_case('kind', fv.RESULT_ORDER['plain'])} END, cr) AS n
  FROM sc WHERE score >= CASE WHEN prefer THEN 3 ELSE 2 END)"""


def _evidence_sql(requests: str, words: str) -> str:
    """Evidence ``ev`` of the requests (status, content, references as lists ``paths`` and ``texts``): goes on from ``ra``."""
    some = "(len(terms) = 0 OR len([t for t in terms if contains({0}, t]) > 0)".replace("t]", "t)]")
    tokens = f"[lower(x) for x in regexp_extract_all(s, '[一-鿿]+|{WORD}')]"
    clean_title = CLEAN_SENTENCE.replace("(c)", f"({clip_sql('title', 400)})").replace("c,", clip_sql("title", 400) + ",")
    return _retrieval_sql(requests, words) + f""",
five AS (SELECT * FROM ra WHERE n <= 5),
cut AS (SELECT request_id, n, terms, qt, question, {S.squeeze('x')} AS s, i FROM (
  SELECT request_id, n, terms, qt, question, {SPLIT.format('text')} AS x, generate_subscripts(regexp_extract_all(text, '[^。！？；!?;\\n]*(?:[。！？；!?;\\n]|$)'), 1) AS i FROM five)),
neat AS (SELECT * FROM (SELECT *, {clip_sql('s', 400)} AS c FROM cut WHERE s <> '') WHERE {CLEAN_SENTENCE}),
sent AS (SELECT *, {any_of('s', LOCAL.industry_sentence)} AND {some.format('s')} AS ind, {any_of('s', CAUSE)} AND {some.format('s')} AS cau, {tokens} AS st,
  len([t for t in terms if contains(s, t)]) AS nt FROM neat),
rated AS (SELECT *, nt + CASE WHEN len(qt) = 0 OR len(st) = 0 THEN 0 ELSE len([x for x in qt if list_contains(st, x)]) + CASE WHEN contains({S.squeeze('s')}, {S.squeeze('question')}) THEN 2 ELSE 0 END END AS w FROM sent),
picks AS (SELECT request_id, n, list(s ORDER BY i) FILTER (ind) AS li, list(s ORDER BY i) FILTER (cau) AS lc, list(s ORDER BY w DESC, i) FILTER (w > 0) AS lb FROM rated GROUP BY 1, 2),
quo AS (SELECT five.*, CASE WHEN industry AND len(li) > 0 THEN li WHEN prefer AND len(lc) > 0 THEN lc WHEN len(lb) > 0 THEN lb[1:3]
  WHEN {some.format('title')} AND {clean_title} THEN [title] END AS chosen FROM five LEFT JOIN picks USING (request_id, n)),
sni AS (SELECT *, array_to_string(CASE WHEN prefer THEN chosen[1:1] ELSE chosen[1:2] END, ' ') AS told FROM quo),
snk AS (SELECT *, {clip_sql('told', 120)} AS k FROM sni),
snp AS (SELECT *, CASE WHEN length(k) >= 12 AND {ratio_sql('k')} <= 0.08 AND (length(k) - length(regexp_replace(k, '[0-9]', '', 'g'))) / greatest(length(k), 1) <= 0.55 THEN k END AS snippet FROM snk),
ref AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n, path, snippet) AS k FROM (
  SELECT request_id, path, snippet, min(n) AS n FROM snp WHERE snippet IS NOT NULL GROUP BY 1, 2, 3) QUALIFY k <= 3),
refs AS (SELECT request_id, list(path ORDER BY k) AS paths, list(snippet ORDER BY k) AS texts FROM ref GROUP BY 1),
fnd AS (SELECT request_id, count(*) AS nc, count(*) FILTER ({any_of('snippet', CAUSE)}) AS ncause, list(title ORDER BY n) AS titles FROM snp GROUP BY 1),
ev0 AS (SELECT rq.request_id, prefer, paths, texts, list_filter(titles, lambda t, i: list_position(titles, t) = i)[1:3] AS titles,
  CASE WHEN nc IS NULL THEN 'no_match' WHEN texts IS NULL AND industry THEN 'titles_only' WHEN texts IS NULL THEN 'no_evidence'
    WHEN product AND NOT (len([t for t in texts if contains(t, '、') AND contains(t, '新增')]) > 0) THEN 'titles_only'
    WHEN prefer AND ncause = 0 THEN 'thin_evidence' ELSE 'answered' END AS status
  FROM rq LEFT JOIN fnd USING (request_id) LEFT JOIN refs USING (request_id)),
ev AS (SELECT *, CASE WHEN status IN ('no_match', 'no_evidence') THEN '{fv.EVIDENCE_NONE}'
    WHEN status = 'titles_only' THEN CASE WHEN texts IS NULL THEN '{fv.EVIDENCE_TITLES}' ELSE '{fv.EVIDENCE_PRODUCT_TITLES}' END || array_to_string(titles, '；')
    WHEN status = 'thin_evidence' THEN '{fv.EVIDENCE_THIN}'
    WHEN prefer THEN '结论：' || texts[1] || chr(10) || '证据依据：' || array_to_string(texts[1:2], '；') ELSE array_to_string(texts[1:3], ' ') END AS content FROM ev0)"""


@query("retrieval_topk", _retrieval_sql(TURN_REQUESTS, TURN_WORDS) + """
SELECT request_id, chunk_id, round(score, 6) AS score, CAST(n AS INTEGER) AS result_rank FROM ra WHERE n <= 5""")
def retrieval_topk(spark, d):
    chunks = RT.in_order(retrieval_chunks(spark, d))
    prepared = written(RT.prepare_requests(RT.spread(retrieval_requests(spark, d)), LOCAL, fv.RETRIEVAL_TERMS, fv.RETRIEVAL_LIMITS))
    top = RT.top_chunks(RT.scored(prepared, chunks, RT.candidates(prepared, chunks, fv.RETRIEVAL_LIMITS), LOCAL))
    return top.select("request_id", "chunk_id", F.round("score", 6).alias("score"), "result_rank")


def _texts(references: str, field: str):
    return F.coalesce(F.array_join(F.col(f"{references}.{field}"), "|"), F.lit(""))


@query("evidence_answers", _evidence_sql(TURN_REQUESTS, TURN_WORDS) + """
SELECT request_id, status, content, coalesce(array_to_string(paths, '|'), '') AS paths, coalesce(array_to_string(texts, '|'), '') AS texts FROM ev""")
def evidence_answers(spark, d):
    out = RT.retrieve(retrieval_requests(spark, d), retrieval_chunks(spark, d), LOCAL, fv.RETRIEVAL_TERMS, fv.RETRIEVAL_LIMITS)
    return out.select("request_id", "status", "content", _texts("references", "paper_path").alias("paths"), _texts("references", "text").alias("texts"))


@query("industry_titles", """
SELECT conv_id * 1000 + turn AS request_id, (SELECT string_agg(text, '|' ORDER BY item_id DESC) FROM (SELECT * FROM benchmark ORDER BY item_id DESC LIMIT 3)) AS titles
FROM conversations WHERE role = 'user' AND """ + any_of(VISIBLE.format("text"), INDUSTRY))
def industry_titles(spark, d):
    prepared = RT.prepare_requests(retrieval_requests(spark, d), LOCAL)
    reports = read(spark, d, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 9, "0").alias("publishDate"), F.col("text").alias("title"))
    nothing = prepared.select("request_id", F.lit("no_match").alias("status"))
    out = RT.industry_fallback(nothing, prepared, reports).filter(F.col("titles").isNotNull())
    return out.select("request_id", F.array_join("titles", "|").alias("titles"))


@query("attribution_facts", sup(f"""
g AS (SELECT a.*, {S.growth('a.net_profit', 'z.net_profit')} AS gr, z.net_profit AS was FROM stmt a LEFT JOIN stmt z ON z.stock_code = a.stock_code AND z.p = a.p AND z.y = a.y - 1)""") + """
SELECT stock_code, report_period, net_profit AS metric_value, CASE WHEN p = 'FY' AND abs(gr) <= 500 THEN gr END AS yoy,
  CASE WHEN p <> 'FY' OR was IS NULL THEN 'unknown' WHEN gr IS NULL THEN 'not_applicable' WHEN abs(gr) <= 500 THEN 'computed' ELSE 'unknown' END AS yoy_status
FROM g WHERE report_period = CASE WHEN CAST(stock_code AS INTEGER) % 2 = 0 THEN '2019Q3' ELSE (SELECT max(report_period) FROM stmt s WHERE s.stock_code = g.stock_code AND p = 'FY') END""")
def attribution_facts(spark, d):
    from ..operators.facts import table_facts
    from .driver_tables import supplier_statements

    facts = table_facts(supplier_statements(spark, d, metrics=("net_profit",)), "income_sheet")
    code = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    requests = read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("request_id"), code.alias("stock_code"), F.lit("net_profit").alias("metric_key"),
        F.when(F.col("s_suppkey") % 2 == 0, "2019Q3").alias("report_period"))
    return RT.attribution_facts(requests, facts).select("stock_code", "report_period", "metric_value", "yoy", "yoy_status")


ATTRIBUTION_ASK = "%s %s tion"
LABEL_TERMS = {  # search terms of a label: whole, first and last four characters, pairs
    label: [label, *([label[:4], label[-4:]] if len(label) >= 4 else []), *[label[i:i + 2] for i in range(len(label) - 1)]]
    for label in ("净利润", "主营业务收入")
}
LABEL_SQL = "CASE label " + " ".join(f"WHEN '{k}' THEN [" + ", ".join(f"'{t}'" for t in v) + "]" for k, v in LABEL_TERMS.items()) + " END"
# every third supplier asks after revenue, the others after profit; every second one names a period
ATTRIBUTION_REQUESTS = """SELECT s_suppkey AS request_id, s_name || ' ' || CASE WHEN s_suppkey % 3 = 0 THEN '主营业务收入' ELSE '净利润' END || ' tion' AS question, true AS prefer,
    lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_name AS abbr, 'name' || (s_suppkey % 70) AS name, CASE WHEN s_suppkey % 3 = 0 THEN '主营业务收入' ELSE '净利润' END AS label FROM supplier"""
ATTRIBUTION_WORDS = f"list_concat(regexp_extract_all({S.squeeze('abbr')}, '{WORD}'), {LABEL_SQL}, ['tion'])"


def money_sql(column: str) -> str:
    return f"CASE WHEN abs({column}) >= 10000 THEN format('{{:.2f}}', {column} / 10000) || '亿元' ELSE format('{{:,.2f}}', {column}) || '万元' END"


@query("attribution_answers", _evidence_sql(ATTRIBUTION_REQUESTS, ATTRIBUTION_WORDS).replace("WITH ", f"WITH {S.SUPPLIER}, ", 1) + f""",
vals AS (SELECT stock_code, report_period, y, p, unnest([net_profit, main_business_revenue]) AS v, unnest(['净利润', '主营业务收入']) AS label FROM stmt),
grow AS (SELECT a.*, {S.growth('a.v', 'z.v')} AS gr, z.v AS was FROM vals a LEFT JOIN vals z ON z.stock_code = a.stock_code AND z.label = a.label AND z.p = a.p AND z.y = a.y - 1),
aim AS (SELECT request_id, code, abbr, rq.label, CASE WHEN request_id % 2 = 0 THEN '2019Q3' ELSE
  (SELECT max(report_period) FROM stmt WHERE stock_code = code AND p = 'FY') END AS period FROM rq),
fact AS (SELECT aim.*, CASE WHEN period IS NULL OR v IS NULL OR abs(v) < 1 THEN '' ELSE '从结构化数据库看，' || abbr || period || '的' || aim.label || '为' || {money_sql('v')} ||
  CASE WHEN p = 'FY' AND abs(gr) <= 500 THEN '，同比' || CASE WHEN gr >= 0 THEN '上升' ELSE '下降' END || format('{{:.2f}}', abs(gr)) || '%'
    WHEN p = 'FY' AND was IS NOT NULL AND gr IS NULL THEN '，同比不适用' ELSE '' END || '。' END AS said
  FROM aim LEFT JOIN grow ON grow.stock_code = code AND grow.label = aim.label AND report_period = period),
own AS (SELECT request_id, rq.abbr, path, chunk_index, {SPLIT.format('ch.text')} AS x,
  generate_subscripts(regexp_extract_all(ch.text, '[^。！？；!?;\\n]*(?:[。！？；!?;\\n]|$)'), 1) AS i
  FROM rq JOIN ch ON (c_code = code OR c_name IN (abbr, name)) AND kind IN ('stock_research_pdf', 'stock_research_meta', 'financial_report_pdf') WHERE rq.label = '主营业务收入'),
owc AS (SELECT * FROM (SELECT *, {clip_sql('s', 400)} AS c FROM (SELECT *, {S.squeeze('x')} AS s FROM own) WHERE s <> '') WHERE {CLEAN_SENTENCE}),
thm AS ({' UNION ALL '.join(f"SELECT {i} AS o, '{n}' AS theme, * FROM owc WHERE {any_of('s', w)}" for i, (n, w) in enumerate(THEMES))}),
th1 AS (SELECT *, substring(s, 1, 180) AS t FROM thm QUALIFY row_number() OVER (PARTITION BY request_id, o ORDER BY path, chunk_index, i) = 1),
thl AS (SELECT request_id, '综合本地财报与研报证据，' || abbr || '主营业务收入上升主要受' || string_agg(theme, '、' ORDER BY o) || '驱动。' AS content FROM th1 GROUP BY request_id, abbr),
prf AS (SELECT request_id, o AS spot, path, t FROM th1 UNION ALL
  SELECT request_id, unnest(range(len(texts))) AS spot, unnest(paths), unnest(texts) FROM ev WHERE request_id NOT IN (SELECT request_id FROM thl)),
prk AS (SELECT *, {clip_sql('t', 120)} AS k FROM prf),
prd AS (SELECT request_id, path, k, min(spot) AS spot FROM prk WHERE length(k) >= 12 AND {ratio_sql('k')} <= 0.08
  AND (length(k) - length(regexp_replace(k, '[0-9]', '', 'g'))) / greatest(length(k), 1) <= 0.55 GROUP BY 1, 2, 3),
pr3 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY spot, path, k) AS n FROM prd QUALIFY n <= 3),
prs AS (SELECT request_id, string_agg(n || '. ' || k, chr(10) ORDER BY n) AS lines, string_agg(path, '|' ORDER BY n) AS paths FROM pr3 GROUP BY 1),
con AS (SELECT fact.*, coalesce(thl.content, ev.content) AS content, lines, prs.paths AS proof, {clip_sql('coalesce(thl.content, ev.content)', 120)} AS short
  FROM fact JOIN ev USING (request_id) LEFT JOIN thl USING (request_id) LEFT JOIN prs USING (request_id))
SELECT request_id, CASE WHEN lines IS NULL THEN 'thin_evidence' ELSE 'answered' END AS status, coalesce(proof, '') AS paths,
  CASE WHEN lines IS NOT NULL THEN CASE WHEN said <> '' THEN said WHEN length(short) >= 12 AND {ratio_sql('short')} <= 0.08 THEN short ELSE content END || chr(10) || '证据依据：' || chr(10) || lines
    WHEN contains(CASE WHEN said <> '' THEN said ELSE content END, '不足') THEN CASE WHEN said <> '' THEN said ELSE content END
    ELSE CASE WHEN said <> '' THEN said ELSE content END || '{fv.ATTRIBUTION_THIN}' END AS summary FROM con""")
def attribution_answers(spark, d):
    from ..operators.facts import table_facts
    from .driver_tables import supplier_statements

    facts = table_facts(supplier_statements(spark, d, metrics=("net_profit", "main_business_revenue")), "income_sheet")
    k = F.col("s_suppkey")
    requests = read(spark, d, "supplier").select(
        k.alias("request_id"), F.lpad(k.cast("string"), 6, "0").alias("stock_code"), F.col("s_name").alias("stock_abbr"),
        F.concat(F.lit("name"), (k % 70).cast("string")).alias("company_name"),
        F.when(k % 3 == 0, "main_business_revenue").otherwise("net_profit").alias("metric_key"),
        F.when(k % 3 == 0, "主营业务收入").otherwise("净利润").alias("metric_label"), F.when(k % 2 == 0, "2019Q3").alias("report_period"))
    out = AT.attribution_answers(
        requests, facts, retrieval_chunks(spark, d), LOCAL, THEMES, least_cjk=0.0, themed=("main_business_revenue",), ask=ATTRIBUTION_ASK,
        terms=fv.RETRIEVAL_TERMS, limits=fv.RETRIEVAL_LIMITS, longest=fv.THEME_SENTENCE)
    return out.select("request_id", "status", _texts("references", "paper_path").alias("paths"), "summary")


# --- extraction --------------------------------------------------------------------------


def report_files(spark, d):
    """Annual report texts written out from the order lines of each supplier and year."""
    price, q = cents("l_extendedprice"), F.quarter("l_shipdate")
    year = F.year("l_shipdate") + YEAR_SHIFT
    lines = read(spark, d, "lineitem").filter(F.col("l_suppkey").isNotNull() & F.col("l_shipdate").isNotNull())
    sums = lines.groupBy(F.col("l_suppkey").alias("s"), year.alias("y")).agg(
        F.sum(price).alias("total"), *[F.coalesce(F.sum(F.when(q == i, price)), F.lit(0)).alias(f"q{i}") for i in (1, 2, 3, 4)])
    units = lambda c: (F.col(c).cast("decimal(19,0)") / 100).cast("decimal(28,2)")
    y = sums.select("s", "y", *[units(c).alias(c) for c in ("total", "q1", "q2", "q3", "q4")])
    # one and two years before, by the year itself: a missing year has no report
    before = lambda n: F.max(F.struct("total")).over(Window.partitionBy("s").orderBy("y").rangeBetween(-n, -n))
    rows = y.select("*", before(1).alias("_one"), before(2).alias("_two")).filter(F.col("_one").isNotNull() & F.col("_two").isNotNull())
    rows = rows.select("*", F.col("_one.total").alias("last"), F.col("_two.total").alias("older")).drop("_one", "_two")
    show = lambda c: F.format_number(c, 2)
    grown = (F.col("total").cast("double") - F.col("last").cast("double")) / F.col("last").cast("double") * 100
    text = F.concat(
        F.lit("证券代码："), F.lpad(F.col("s").cast("string"), 6, "0"), F.lit(" "), F.col("y").cast("string"), F.lit("年年度报告\n主要会计数据和财务指标 单位：元\n营 业收入 "),
        show(F.col("total")), F.lit(" "), show(F.col("last")), F.lit(" "), F.format_string("%.2f", grown), F.lit("% "), show(F.col("older")),
        F.lit("\n总资产 "), show(F.col("total") * 2), F.lit(" "), show(F.col("last") * 2), F.lit(" 不适用 "), show(F.col("older") * 2),
        F.lit("\n基本每股收益 1.25 1.10 13.64% 0.95\n分季度主要财务指标\n营业收入 "), show(F.col("q1")), F.lit(" "), show(F.col("q2")), F.lit(" "), show(F.col("q3")), F.lit(" "), show(F.col("q4")),
        F.lit("\n归属于上市公司股东的净利润 无\n"),
    )
    stem = F.concat(F.lpad(F.col("s").cast("string"), 6, "0"), F.lit("_"), (F.col("y") + 1).cast("string"), F.lit("0331"))
    return rows.select(F.concat(F.lit("reports/"), stem, F.lit(".pdf")).alias("path"), F.length(text).alias("length"), text.alias("text"))


def reports(spark, d):
    scanned = CH.scan_reports(report_files(spark, d))
    known = C.attach_company(scanned, company_master(spark, d))
    # the sort samples its rows before it moves them: texts are made and scanned once, not for both
    return global_row_number(written(known), ["file_path"], "doc_seq")


REPORT_SQL = """
yr AS (SELECT key, y, gross FROM cum WHERE p = 'FY'),
rep AS (SELECT a.key, a.y, lpad(CAST(a.key AS VARCHAR), 6, '0') AS stock_code, a.gross, b.gross AS last, c.gross AS older
  FROM yr a JOIN yr b ON b.key = a.key AND b.y = a.y - 1 JOIN yr c ON c.key = a.key AND c.y = a.y - 2),
grown AS (SELECT *, (gross - last) / last * 100 AS g FROM rep)
"""


@query("report_scan", sup(REPORT_SQL) + """
SELECT 'reports/' || stock_code || '_' || (y + 1) || '0331.pdf' AS file_path, stock_code, 'Supplier#' || lpad(CAST(key AS VARCHAR), 9, '0') AS stock_abbr,
  CAST(y AS VARCHAR) || 'FY' AS report_period, CAST(y + 1 AS VARCHAR) || '-03-31' AS report_date,
  row_number() OVER (ORDER BY 'reports/' || stock_code || '_' || (y + 1) || '0331.pdf') AS doc_seq FROM rep""")
def report_scan(spark, d):
    return reports(spark, d).select("file_path", "stock_code", "stock_abbr", "report_period", "report_date", "doc_seq")


EXTRACTED = sup(REPORT_SQL) + """,
qs AS (SELECT r.stock_code, r.y, c.p, SUM(CAST(byq.gross AS DOUBLE)) AS v FROM rep r JOIN (SELECT * FROM (VALUES ('Q1', 1), ('HY', 2), ('Q3', 3)) t(p, k)) c ON true
  LEFT JOIN byq ON byq.key = r.key AND byq.y = r.y AND byq.q <= c.k GROUP BY 1, 2, 3),
ex AS (
  SELECT stock_code, CAST(y AS VARCHAR) || 'FY' AS report_period, f AS field_name, v AS value FROM (
    SELECT stock_code, y, unnest(['total_operating_revenue', 'main_business_revenue', 'operating_revenue_yoy_growth', 'main_business_revenue_yoy_growth', 'asset_total_assets', 'asset_total_assets_yoy_growth', 'eps']) AS f,
      unnest([gross / 10000, gross / 10000, CASE WHEN abs(g) <= 300 THEN round(g, 2) END, CASE WHEN abs(g) <= 300 THEN round(g, 2) END, gross * 2 / 10000, CASE WHEN abs(g) <= 300 THEN round(g, 2) END, 1.25]) AS v FROM grown)
  UNION ALL SELECT stock_code, CAST(y AS VARCHAR) || p, unnest(['total_operating_revenue', 'main_business_revenue']), coalesce(v, 0) / 10000 FROM qs)
"""


@query("extracted_statements", EXTRACTED + "SELECT stock_code, report_period, field_name, round(value, 2) AS value FROM ex WHERE value IS NOT NULL")
def extracted_statements(spark, d):
    docs = reports(spark, d)
    won = RES.resolve_fields(X.extract(docs))
    kept = X.within_allowed_periods(won, docs)
    return kept.select("stock_code", "report_period", "field_name", F.round("value", 2).alias("value"))


@query("extracted_income_rows", EXTRACTED + """
SELECT stock_code, report_period, round(max(value) FILTER (field_name = 'total_operating_revenue'), 1) AS revenue, 'reports/' || stock_code || '_' || (CAST(report_period[1:4] AS INTEGER) + 1) || '0331.pdf' AS source_file
FROM ex WHERE field_name IN ('total_operating_revenue', 'main_business_revenue') GROUP BY 1, 2""")
def extracted_income_rows(spark, d):
    docs = reports(spark, d)
    cand = X.extract(docs)
    sheet = RES.widen(RES.resolve_fields(cand), "income_sheet", RES.row_sources(cand))
    sheet = X.with_metric_values(X.within_allowed_periods(sheet, docs), ["total_operating_revenue", "net_profit"])
    return sheet.select("stock_code", "report_period", F.round("total_operating_revenue", 1).alias("revenue"), "source_file")


@query("code_normalization", """
SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS stock_code FROM orders WHERE o_orderkey < 1000000 UNION ALL SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey >= 1000000""")
def code_normalization(spark, d):
    code = F.concat(F.lit(" SZ"), F.col("o_orderkey").cast("string"), F.lit(" "))
    return read(spark, d, "orders").select("o_orderkey", normalize_code(code).alias("stock_code"))
