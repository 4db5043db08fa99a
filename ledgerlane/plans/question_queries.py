"""Queries on question tables: bank, tags, conversations and batch answers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.questions import canonical_question, detect_top_k, payload_questions
from ..functions.periods import question_period
from ..lexicon import DEFAULT
from ..operators import answers as A
from ..operators import bank as B
from ..operators import conversation as CV
from ..operators import facts as FA
from ..operators import lookups as L
from ..operators import matching as M
from ..operators import tagging as TG
from . import sql as S
from .driver_tables import read, supplier_statements
from .registry import query
from .statement_queries import CLEAN, SHAPE, company_master, sup
from .text_queries import any_of

CONNECTOR = "nicht"
LOCAL = DEFAULT.but(
    metrics=(("income_sheet", "net_profit", "profit", None, ("ung", "elle")), ("balance_sheet", "asset_total_assets", "assets", None, ("keit",))),
    company_fields=(("dans", "industry", "industry"),),
    chart=("pour",), trend=("was", "eaux"), trend_years="(?!)", attribution=("whst",), latest=("une",), research=("sich",), industry=("einach",),
    product=("und",), follow_up=("with",), ranking=("hed",), yoy=("lich",), maximum=("ment",), minimum=("von",), connectors=(CONNECTOR,),
    company_set=("for",), compare=("ouè",), threshold=("queau",), max_growth=("eauou",), listing=("thre",), cross_company=("hed",),
    product_groups=(("einach",), ("und",)), rewrites=(), label_analysis=("was", "lich"), label_cause=("whst",), label_open=("ouè", "dans"),
    label_fusion=("keit",), label_validation=("von",), label_ambiguous=("the", "und"),
)


@query("question_dedupe", """
SELECT 'B' || (conv_id % 50) AS question_id, role AS question_type, text AS question_payload, min('f' || turn) AS source_file FROM conversations GROUP BY 1, 2, 3""")
def question_dedupe(spark, d):
    rows = read(spark, d, "conversations").select(
        F.concat(F.lit("B"), F.col("conv_id") % 50).alias("question_id"), F.col("role").alias("question_type"), F.col("text").alias("question_payload"),
        F.concat(F.lit("f"), "turn").alias("source_file"), F.col("conv_id").alias("row_seq"))
    return B.load_bank(rows).drop("row_seq")


SQ = S.squeeze("text")


@query("question_id_match", f"""
WITH b AS (SELECT item_id, {SQ} AS t FROM benchmark),
k AS (SELECT 'B' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS id, CASE WHEN item_id % 2 = 0 THEN [t] ELSE [t, 'second'] END AS q FROM b),
p AS (SELECT item_id AS id, t FROM b UNION ALL SELECT 1000000 + conv_id * 10 + turn, {SQ} FROM conversations),
e AS (SELECT q, min(id) AS id FROM k GROUP BY q), u AS (SELECT t, count(DISTINCT id) AS n, min(id) AS id FROM (SELECT unnest(q) AS t, id FROM k) GROUP BY t)
SELECT p.id AS payload_id, coalesce((SELECT e.id FROM e WHERE e.q = [p.t]), (SELECT u.id FROM u WHERE u.t = p.t AND n = 1)) AS question_id FROM p""")
def question_id_match(spark, d):
    b = read(spark, d, "benchmark")
    both = F.to_json(F.array(F.struct(F.col("text").alias("Q")), F.struct(F.lit("second").alias("Q"))))
    bank = b.select(
        F.concat(F.lit("B"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("question_id"),
        F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(both).alias("question_payload"))
    asked = b.select(F.col("item_id").alias("payload_id"), F.col("text").alias("payload")).unionByName(
        read(spark, d, "conversations").select((1000000 + F.col("conv_id") * 10 + F.col("turn")).alias("payload_id"), F.col("text").alias("payload")))
    return B.match_question_ids(asked.withColumn("current_id", F.lit("")), bank).select("payload_id", "question_id")


# --- template questions ------------------------------------------------------------------

NAME = "'Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')"


def _template_sql() -> str:
    counts, rows = {}, []
    for declared, _, questions in fv.QUESTION_TEMPLATES:
        counts[declared] = counts.get(declared, 0) + 1
        qid = f"SYS{fv.QUESTION_LABELS.index(declared) + 1}{counts[declared]:03d}"
        text = questions[0] if len(questions) == 1 else json.dumps([{"Q": q} for q in questions], ensure_ascii=False, separators=(",", ":"))
        rows.append(f"('{qid}', '{declared}', '{text}')")
    fill = "t"
    for slot, value in (("company", NAME), ("year", "'2021'"), ("revenue", "'主营业务收入'"), ("profit", "'净利润'"), ("cash", "'净现金流'")):
        fill = f"replace({fill}, '{{{slot}}}', {value})"
    return f"""SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code, id AS question_id, kind AS question_type, {fill} AS question_payload
FROM supplier, (VALUES {', '.join(rows)}) v(id, kind, t)"""


def _facts(spark, d):
    sheet = supplier_statements(spark, d)
    return FA.table_facts(sheet, "income_sheet").unionByName(FA.table_facts(sheet, "cash_flow_sheet"))


def _templates(spark, d):
    facts = _facts(spark, d)
    return B.expand_templates(company_master(spark, d), B.company_years(facts), B.company_metric_keys(facts))


@query("template_questions", _template_sql())
def template_questions(spark, d):
    return _templates(spark, d).drop("title")




@query("template_labels", "SELECT question_id, question_type AS primary_label, count(*) AS n FROM (" + _template_sql() + ") GROUP BY 1, 2")
def template_labels(spark, d):
    tagged = TG.question_labels(_templates(spark, d), "question_payload", F.col("question_type"))
    return tagged.groupBy("question_id", "primary_label").agg(F.count(F.lit(1)).alias("n"))


@query("question_bank", "WITH t AS (" + _template_sql() + f"""), c AS (SELECT 'B' || conv_id AS question_id, {SQ} AS p FROM conversations WHERE role = 'user')
SELECT '系统生成' AS scope, count(*) AS n, count(DISTINCT question_id) AS ids FROM t UNION ALL
SELECT '官方题库', count(*), count(DISTINCT question_id) FROM (SELECT DISTINCT question_id, p FROM c WHERE p <> '')""")
def question_bank(spark, d):
    official = read(spark, d, "conversations").filter(F.col("role") == "user").select(
        F.concat(F.lit("B"), "conv_id").alias("question_id"), F.lit("数据基本查询").alias("question_type"), F.col("text").alias("question_payload"))
    bank = B.assemble_bank(_templates(spark, d), official)
    return bank.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("question_id").alias("ids"))


@query("sample_questions", "WITH t AS (" + _template_sql() + """)
SELECT CAST(row_number() OVER (ORDER BY id, display) AS INTEGER) AS position, display FROM (
  SELECT question_payload AS display, min(question_id) AS id FROM t GROUP BY 1 ORDER BY 2, 1 LIMIT 8)""")
def sample_questions(spark, d):
    official = read(spark, d, "benchmark").select(
        F.concat(F.lit("B"), "item_id").alias("question_id"), F.lit("x").alias("question_type"), F.col("text").alias("question_payload"))
    return B.sample_questions(B.assemble_bank(_templates(spark, d), official))


# --- tags --------------------------------------------------------------------------------

COMPACT = r"regexp_replace(text, '\s+', '', 'g')"


def _tags_sql() -> str:
    c = lambda *lists: any_of("t", tuple(w for x in lists for w in x))
    x = LOCAL
    trend, attribution = c(x.chart, x.trend), c(x.attribution)
    yoy, extreme, growth = c(x.yoy), c(x.maximum, x.minimum), c(x.max_growth)
    compare = f"(({c(x.listing)} OR {c(x.company_set)}) AND ({c(x.compare)} OR {yoy}))"
    bounded = f"({c(x.threshold)} AND {extreme})"
    metric = any_of("s", ("ung", "elle", "keit"))
    ranking = f"({c(x.ranking)} OR {compare} OR {bounded} OR ({c(x.listing)} AND ({yoy} OR {extreme})))"
    return f"""
a AS (SELECT conv_id, turn, {SQ} AS s, {COMPACT} AS t FROM conversations),
i AS (SELECT *, {trend} AS trend, {attribution} AS attribution, {ranking} AS ranking, ({yoy} OR {growth} OR {compare}) AS yoy, ({extreme} OR {growth} OR {bounded}) AS maxmin,
  {compare} AS compare, {bounded} AS bounded, {metric} AS metric, {c(x.research)} AS research, {c(x.industry)} AS industry, {c(x.latest)} AS latest, {c(x.chart)} AS chart,
  contains(s, 'dans') AS field, {c(('einach',))} AND {c(('und',))} AS product_list FROM a),
j AS (SELECT *, NOT (trend OR attribution OR ranking OR yoy OR maxmin) AND metric AS single,
  trim(regexp_extract(s, '^(.+?)whst', 1)) AS lead, list_filter([trim(p) for p in string_split(s, '{CONNECTOR}')], lambda p: p <> '') AS pieces FROM i),
k AS (SELECT *, concat_ws(',', CASE WHEN ranking THEN 'ranking' END, CASE WHEN single THEN 'single_value' END, CASE WHEN yoy THEN 'yoy' END, CASE WHEN maxmin THEN 'maxmin' END,
    CASE WHEN trend THEN 'trend' END, CASE WHEN attribution THEN 'attribution' END) AS intents,
  CASE WHEN s = '' THEN 0 WHEN trend AND attribution AND lead <> '' AND NOT starts_with(s, 'whst') THEN 2
    WHEN contains(s, '{CONNECTOR}') AND len(pieces) >= 2 THEN len(list_distinct(pieces)) ELSE 1 END AS n_fragments FROM j),
tags AS (SELECT *, CASE WHEN ranking AND yoy AND maxmin THEN 'ranking_yoy_max_pipeline' WHEN trend AND attribution THEN 'trend_then_attribution'
    WHEN n_fragments > 1 THEN 'fragment_split' WHEN bounded THEN 'threshold_then_extreme' WHEN compare THEN 'list_then_compare' ELSE 'single_intent' END AS pipeline,
  CASE WHEN field THEN 'company_profile' WHEN research THEN 'research' WHEN industry THEN 'industry_lookup' WHEN attribution THEN 'attribution'
    WHEN compare OR bounded THEN 'ranking' WHEN trend THEN 'trend' WHEN metric THEN 'structured' ELSE 'retrieval' END AS query_mode FROM k)"""


@query("question_tags", "WITH " + _tags_sql() + """
SELECT conv_id, turn, intents, CAST(n_fragments AS INTEGER) AS n_fragments, pipeline, query_mode, product_list, research AS wants_research, latest AS wants_latest, chart AS wants_chart FROM tags""")
def question_tags(spark, d):
    t = TG.tag_questions(read(spark, d, "conversations").select("conv_id", "turn", "text"), "text", LOCAL)
    return t.select(
        "conv_id", "turn", F.array_join("intents", ",").alias("intents"), F.size("fragments").alias("n_fragments"), "pipeline",
        TG.query_mode(F.lit(False)).alias("query_mode"), "product_list", "wants_research", "wants_latest", "wants_chart")


@query("tag_counts", "WITH " + _tags_sql() + f""",
f AS (SELECT *, {any_of('s', LOCAL.label_validation)} AS val, {any_of('s', LOCAL.label_cause)} AS cause, {any_of('s', LOCAL.label_open)} AS opn, {any_of('s', LOCAL.label_fusion)} AS fus,
  n_fragments > 1 OR len(string_split(intents, ',')) > 1 OR pipeline IN ('ranking_yoy_max_pipeline', 'trend_then_attribution', 'threshold_then_extreme', 'list_then_compare') AS multi FROM tags),
g AS (SELECT *, {any_of('s', LOCAL.label_analysis)} OR ranking OR yoy OR maxmin OR trend OR attribution OR val OR cause OR opn OR fus AS ana FROM f),
h AS (SELECT *, NOT ana AND NOT regexp_matches(s, '20[0-9]{{2}}') AND {any_of('s', LOCAL.label_ambiguous)} AS vague FROM g)
SELECT label, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT ana THEN '数据基本查询' END, CASE WHEN ana THEN '数据统计分析查询' END, CASE WHEN multi THEN '多意图' END,
  CASE WHEN vague THEN '意图模糊' END, CASE WHEN cause THEN '归因分析' END, CASE WHEN opn THEN '开放性问题' END, CASE WHEN fus OR (multi AND (cause OR opn)) THEN '融合查询' END,
  CASE WHEN val THEN '数据校验' END], lambda x: x IS NOT NULL)) AS label FROM h) GROUP BY 1""")
def tag_counts(spark, d):
    tagged = TG.question_labels(read(spark, d, "conversations").select("text"), "text", lex=LOCAL)
    return TG.label_counts(tagged)


@query("question_slots", """
SELECT o_orderkey, CAST(year(o_orderdate) + 20 AS VARCHAR) || CASE o_orderkey % 3 WHEN 0 THEN 'Q3' WHEN 1 THEN 'HY' ELSE 'FY' END AS report_period,
  CAST(5 + o_orderkey % 7 AS INTEGER) AS top_k, o_orderkey % 2 = 0 AS rewritten FROM orders""")
def question_slots(spark, d):
    k = F.col("o_orderkey")
    part = F.when(k % 3 == 0, "第三季度").when(k % 3 == 1, "半年度").otherwise("")
    text = F.concat((F.year("o_orderdate") + 20).cast("string"), F.lit(" 年"), part, F.lit("净利润top "), (5 + k % 7).cast("string"), F.lit("企业，"),
                    F.when(k % 2 == 0, "谁增长最快").otherwise("列表"))
    p = question_period(text)
    return read(spark, d, "orders").select(
        "o_orderkey", p["report_period"].alias("report_period"), detect_top_k(text).alias("top_k"),
        canonical_question(text).endswith(" 同比增幅最大").alias("rewritten"))


@query("payload_questions", "SELECT conv_id, turn, CAST(CASE turn % 3 WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS n, trim(text, chr(10) || ' ') AS first FROM conversations")
def payloads(spark, d):
    t, m = F.col("text"), F.col("turn") % 3
    raw = (
        F.when(m == 0, t)
        .when(m == 1, F.concat(F.lit("["), F.to_json(F.struct(t.alias("Q"))), F.lit(', "plain", 7, {"X": 1}]')))
        .otherwise(F.to_json(F.array(t)))
    )
    q = payload_questions(raw)
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(q).alias("n"), F.get(q, 0).alias("first"))


# --- conversations -----------------------------------------------------------------------

FOLLOW_ENDS = (".",)
FOLLOW_STARTS = ("In", "La")
COMPANY_WORDS = (("000001", "pour"), ("000002", "von"), ("000003", "ble"))


def _signals(spark, d):
    code = F.lit(None).cast("string")
    for c, w in reversed(COMPANY_WORDS):
        code = F.when(F.col("text").contains(w), c).otherwise(code)
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("question"), code.alias("stock_code"))
    return CV.turn_signals(rows, lex=LOCAL, follow_starts=FOLLOW_STARTS, follow_ends=FOLLOW_ENDS)


def _slots_sql() -> str:
    x = LOCAL
    c = lambda words: any_of("t", words)
    code = "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{k}'" for k, w in COMPANY_WORDS) + " END"
    return f"""WITH RECURSIVE a AS (SELECT conv_id, turn, text, {COMPACT} AS t, {SQ} AS s FROM conversations),
g AS (SELECT conv_id, turn, {code} AS company,
  CASE WHEN contains(s, 'elle') OR contains(s, 'keit') THEN CASE WHEN contains(s, 'elle') THEN 'net_profit' ELSE 'asset_total_assets' END WHEN contains(s, 'ung') THEN 'net_profit' END AS metric,
  contains(s, 'dans') AS field, {c(x.attribution)} AS att, {c(x.research)} AS res, {c(x.industry)} AS ind, {c(x.chart)} OR {c(x.trend)} AS trd, {c(x.latest)} AS lat,
  {c(x.follow_up)} OR {c(x.company_set)} AS hint, length(t) <= 8 AND ends_with(t, '.') AS short, starts_with(t, 'In') OR starts_with(t, 'La') AS starts FROM a),
f AS (SELECT g.conv_id, g.turn, false AS follow_up, g.company AS c, g.metric AS m, CASE WHEN g.company IS NOT NULL THEN 1 ELSE 0 END AS sk, g.company AS sv, 0 AS sk0, CAST(NULL AS VARCHAR) AS sv0 FROM g WHERE turn = 0
  UNION ALL
  SELECT conv_id, turn, fu, c2, coalesce(metric, m), CASE WHEN c2 IS NOT NULL THEN 1 ELSE sk END, CASE WHEN c2 IS NOT NULL THEN c2 ELSE sv END, sk, sv FROM (
    SELECT *, coalesce(company, CASE WHEN hint AND sk = 1 THEN sv END, CASE WHEN fu THEN c END) AS c2 FROM (
      SELECT g.*, f.c, f.m, f.sk, f.sv, CASE WHEN f.c IS NULL AND f.m IS NULL THEN false WHEN ind AND company IS NULL AND metric IS NULL AND NOT field THEN false
        WHEN res AND company IS NULL THEN false WHEN hint THEN true WHEN field AND company IS NULL THEN f.c IS NOT NULL WHEN att AND company IS NULL THEN starts
        WHEN metric IS NOT NULL AND company IS NULL AND f.c IS NOT NULL AND short THEN true
        WHEN company IS NOT NULL AND metric IS NULL AND f.m IS NOT NULL AND (att OR short) THEN true
        WHEN company IS NULL AND metric IS NULL AND NOT trd AND NOT lat AND short THEN true ELSE false END AS fu
      FROM f JOIN g ON g.conv_id = f.conv_id AND g.turn = f.turn + 1)))
SELECT conv_id, turn, follow_up, c AS stock_code, m AS metric_key, sk0 AS set_kind, sv0 AS set_value FROM f"""


@query("slot_carry_forward", _slots_sql())
def slot_carry_forward(spark, d):
    return CV.carry_slots(_signals(spark, d)).drop("report_period")


@query("slot_carry_forward_segmented", _slots_sql())
def slot_carry_forward_segmented(spark, d):
    """The same with two turns per segment, so that every level of the composition runs."""
    return CV.carry_slots(_signals(spark, d), fan=2).drop("report_period")


# --- batch answers -----------------------------------------------------------------------

ASKED = (
    ("a", "{name}2020年的净利润是多少"), ("b", "2020年净利润top3企业是哪些"), ("c", "2019年净利润超过300的公司有哪些"),
    ("d", "{name}近三年的净利润变化趋势"), ("e", "{name}的所属行业是什么"), ("f", "净利润是多少"), ("g", "{name}净利润最新是多少"),
    ("i", "2020年净利润top5企业中同比增幅最大的是哪家"), ("k", "{name}2020年的净利润是多少，2019年的净利润是多少"),
)
# payloads of several questions: a ranking, then what is extreme among its companies
ASKED_IN_TURN = (
    ("h", ("{name}2020年的净利润是多少", "那2019年呢")), ("j", ("2020年净利润top3企业是哪些", "这些公司里2020年净利润最低的是哪家", "这些公司里2020年净利润同比增幅最高的是哪家")),
)


def _questions(spark, d):
    name = F.col("s_name")
    rows = F.array(*[
        F.struct(F.concat(F.lit(k), F.col("s_suppkey").cast("string")).alias("question_id"), F.replace(F.lit(t), F.lit("{name}"), name).alias("payload")) for k, t in ASKED
    ])
    turns = F.array(*[
        F.struct(F.concat(F.lit(k), F.col("s_suppkey").cast("string")).alias("question_id"),
                 F.to_json(F.array(*[F.replace(F.lit(t), F.lit("{name}"), name) for t in asked])).alias("payload")) for k, asked in ASKED_IN_TURN
    ])
    return read(spark, d, "supplier").select(F.inline(F.concat(rows, turns)))


def _answers(spark, d):
    master, facts = company_master(spark, d), FA.table_facts(supplier_statements(spark, d, metrics=("net_profit",)), "income_sheet")
    aliases = M.company_names(master)
    questions = _questions(spark, d)
    planned = A.plan_answers(A.explode_steps(questions), aliases, facts)
    return questions, A.answer_all(planned, facts, master, L.latest_fy(facts))


def _cases(column: str, forms) -> str:
    """SQL for a text per code, with the columns that the %s of a form stand for."""
    return f"CASE {column} " + " ".join(f"WHEN '{code}' THEN format('{form.replace('%s', '{}')}', {args})" for code, form, args in forms) + " END"


TREND = f"""CASE WHEN n_periods = 1 THEN '净利润目前仅有' || low_period || '一期数据（' || low_shown || '）' ELSE concat_ws('，',
    span || '的净利润呈“' || {_cases("pattern", [("v_shape", "V型反转强波动走势", "''"), ("inverted_v", "倒V型波动走势", "''"), ("rising", "持续上升走势", "''"), ("falling", "持续下降走势", "''"), ("mixed", "波动走势", "''")])} || '”',
    CASE WHEN decline IS NULL THEN low_period || '为阶段低点（' || low_shown || '）' WHEN decline = 'steady' THEN first_period || '至' || low_period || '持续回落并在' || low_period || '触底' ELSE low_period || '为阶段低点' END,
    CASE WHEN decline IS NULL THEN high_period || '为阶段高点（' || high_shown || '）' ELSE {_cases("recovery", [("steady", "此后持续修复至%s", "last_period"), ("uneven", "此后震荡修复至%s", "last_period")])} END,
    {_cases("recent_move", [("improving", "%s至%s季度改善显著", "recent_start, last_period"), ("falling_back", "%s至%s季度主要表现为回落", "recent_start, last_period")])}) || '。' END"""

def _scalar(period: str) -> str:
    return f"'SELECT net_profit FROM income_sheet WHERE stock_code = ''' || stock_code || ''' AND report_period = ''{period}'''"


def _top(more: str, k: int) -> str:
    return f"'SELECT stock_code, stock_abbr{more}, net_profit AS metric_value FROM income_sheet WHERE report_period = ''2020FY'' ORDER BY metric_value DESC LIMIT {k}'"


SET_SQL = "'SELECT stock_code, stock_abbr, net_profit AS metric_value FROM income_sheet WHERE report_period = ''2020FY'' AND stock_code IN (' || codes || ')'"

ANSWERS = sup(CLEAN.format("stmt", "CASE WHEN n_fy >= 3 THEN 3 ELSE 6 END", "n_fy < 3 OR p = 'FY'")) + SHAPE + """,
told AS (SELECT stock_code, """ + TREND + """ AS told FROM (
  SELECT *, trim(format('{:,.2f}', low_value)) || '万元' AS low_shown, trim(format('{:,.2f}', high_value)) || '万元' AS high_shown FROM shape)),
v AS (SELECT stock_code, stock_abbr, report_period, net_profit AS v FROM stmt),
fmt AS (SELECT *, trim(format('{:,.2f}', v)) || '万元' AS shown FROM v),
sups AS (SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
top AS (SELECT string_agg(n || '. ' || stock_abbr || '（' || stock_code || '）: ' || shown, '；' ORDER BY n) AS l FROM (
  SELECT *, row_number() OVER (ORDER BY v DESC, stock_code) AS n FROM fmt WHERE report_period = '2020FY') WHERE n <= 3),
ovr AS (SELECT string_agg(n || '. ' || stock_abbr || '（' || stock_code || '）: ' || shown, '；' ORDER BY n) AS l, count(*) AS c FROM (
  SELECT *, row_number() OVER (ORDER BY v DESC, stock_code) AS n FROM fmt WHERE report_period = '2019FY' AND v > 300)),""" + f"""
grow AS (SELECT a.*, row_number() OVER (ORDER BY a.v DESC, a.stock_code) AS n, CASE WHEN z.v = 0 OR a.v * z.v < 0 THEN NULL ELSE (a.v - z.v) / abs(z.v) * 100 END AS raw, z.v AS was
  FROM fmt a LEFT JOIN v z ON z.stock_code = a.stock_code AND z.report_period = '2019FY' WHERE a.report_period = '2020FY'),
grown AS (SELECT *, CASE WHEN abs(raw) <= 500 THEN raw END AS yoy,
  CASE WHEN was IS NULL THEN '未知' WHEN raw IS NULL THEN '不适用' WHEN abs(raw) > 500 THEN '未知' ELSE printf('%.2f', raw) || '%' END AS growth FROM grow),
best5 AS (SELECT '2020FY Top5 企业中，净利润同比增幅最高的是' || (SELECT stock_abbr || '，为 ' || growth FROM grown WHERE n <= 5 AND yoy IS NOT NULL ORDER BY yoy DESC, n LIMIT 1) || '。' || chr(10)
  || (SELECT string_agg(n || '. ' || stock_abbr || '：' || shown || '，同比' || growth, chr(10) ORDER BY n) FROM grown WHERE n <= 5) AS l),
set3 AS (SELECT '在上一轮命中的 3 家公司里，2020FY净利润最低的是' || (SELECT stock_abbr || '，为 ' || shown FROM grown WHERE n <= 3 ORDER BY v, stock_code LIMIT 1) || '。' AS low,
  '在上一轮命中的 3 家公司里，2020FY净利润同比增幅最高的是' || (SELECT stock_abbr || '，为 ' || growth FROM grown WHERE n <= 3 AND yoy IS NOT NULL ORDER BY yoy DESC, stock_code LIMIT 1) || '。' AS high,
  (SELECT string_agg('''' || stock_code || '''', ', ' ORDER BY stock_code) FROM grown WHERE n <= 3) AS codes),
said AS (
  SELECT 'a' || k AS question_id, 0 AS seq, s_name || '2020年的净利润是多少' AS question, 'scalar' AS route, s_name || '2020FY的净利润为：' || shown AS content, {_scalar('2020FY')} AS sql
    FROM sups JOIN fmt USING (stock_code) WHERE report_period = '2020FY'
  UNION ALL SELECT 'b' || k, 0, '2020年净利润top3企业是哪些', 'ranking', '2020FY的净利润排名结果如下：' || l, {_top(', report_period', 3)} FROM sups, top
  UNION ALL SELECT 'c' || k, 0, '2019年净利润超过300的公司有哪些', 'threshold', '2019FY命中净利润的公司共' || c || '家：' || coalesce(l, ''),
    'SELECT stock_code, stock_abbr, report_period, net_profit AS metric_value FROM income_sheet WHERE report_period = ''2019FY'' AND net_profit > 300.0 ORDER BY metric_value DESC' FROM sups, ovr
  UNION ALL SELECT 'd' || k, 0, s_name || '近三年的净利润变化趋势', 'trend', s_name || '（' || stock_code || '）' || coalesce(told, '净利润暂无可用趋势数据'),
    'SELECT report_period, net_profit FROM income_sheet WHERE stock_code = ''' || stock_code || ''' ORDER BY report_period' FROM sups LEFT JOIN told USING (stock_code)
  UNION ALL SELECT 'e' || k, 0, s_name || '的所属行业是什么', 'company_profile', s_name || '的所属证监会行业为：' || n_name, 'SELECT industry FROM company_info WHERE stock_code = ''' || stock_code || '''' FROM sups
  UNION ALL SELECT 'f' || k, 0, '净利润是多少', 'clarify', 'missing_company', '' FROM sups
  UNION ALL SELECT 'g' || k, 0, s_name || '净利润最新是多少', 'latest', s_name || report_period || '的净利润为：' || shown,
    'SELECT report_period, net_profit FROM income_sheet WHERE stock_code = ''' || stock_code || ''' ORDER BY report_period DESC LIMIT 1'
    FROM sups JOIN fmt USING (stock_code) QUALIFY report_period = max(report_period) OVER (PARTITION BY stock_code)
  UNION ALL SELECT 'h' || k, 0, s_name || '2020年的净利润是多少', 'scalar', s_name || '2020FY的净利润为：' || shown, {_scalar('2020FY')} FROM sups JOIN fmt USING (stock_code) WHERE report_period = '2020FY'
  UNION ALL SELECT 'h' || k, 1, '那2019年呢', 'scalar', s_name || '2019FY的净利润为：' || shown, {_scalar('2019FY')} FROM sups JOIN fmt USING (stock_code) WHERE report_period = '2019FY'
  UNION ALL SELECT 'i' || k, 0, '2020年净利润top5企业中同比增幅最大的是哪家', 'ranking_growth', l, {_top('', 5)} FROM sups, best5
  UNION ALL SELECT 'j' || k, 0, '2020年净利润top3企业是哪些', 'ranking', '2020FY的净利润排名结果如下：' || l, {_top(', report_period', 3)} FROM sups, top
  UNION ALL SELECT 'j' || k, 1, '这些公司里2020年净利润最低的是哪家', 'set_extreme', low, {SET_SQL} FROM sups, set3
  UNION ALL SELECT 'j' || k, 2, '这些公司里2020年净利润同比增幅最高的是哪家', 'set_extreme', high, {SET_SQL} FROM sups, set3
  UNION ALL SELECT 'k' || k, 0, s_name || '2020年的净利润是多少，2019年的净利润是多少', 'scalar', '1. ' || s_name || '2020FY的净利润为：' || a.shown || chr(10) || '2. ' || s_name || '2019FY的净利润为：' || b.shown,
    {_scalar('2020FY')} || chr(10) || chr(10) || {_scalar('2019FY')} FROM sups JOIN fmt a USING (stock_code) JOIN fmt b USING (stock_code) WHERE a.report_period = '2020FY' AND b.report_period = '2019FY'),
ans AS (SELECT *, CASE WHEN starts_with(route, 'ranking') THEN '柱状图' WHEN route = 'trend' THEN '折线图' END AS chart FROM said)"""


@query("batch_answers", ANSWERS + "SELECT question_id, CAST(seq AS INTEGER) AS seq, question, route, content, chart, sql FROM ans")
def batch_answers(spark, d):
    return _answers(spark, d)[1].select("question_id", "seq", "question", "route", "content", "chart", "sql")


@query("export_rows", ANSWERS + """
SELECT question_id AS "编号", CASE WHEN left(question_id, 1) IN ('h', 'j') THEN CAST(to_json(list(question ORDER BY seq)) AS VARCHAR) ELSE any_value(question) END AS "问题",
  coalesce(string_agg(sql, chr(10) ORDER BY seq) FILTER (sql <> ''), '') AS "SQL查询语句", coalesce(min(chart), '无') AS "图形格式",
  '[' || string_agg('{"Q":' || CAST(to_json(question) AS VARCHAR) || ',"A":{"content":' || CAST(to_json(content) AS VARCHAR) || '}}', ',' ORDER BY seq) || ']' AS "回答" FROM ans GROUP BY 1""")
def export_rows(spark, d):
    questions, out = _answers(spark, d)
    return A.export_rows(A.assemble(out), questions)


@query("flat_records", ANSWERS + "SELECT question_id, CAST(seq AS INTEGER) AS seq, question, content, '' AS reference_paths, '' AS reference_texts FROM ans")
def flat_records(spark, d):
    return A.flat_records(_answers(spark, d)[1])
