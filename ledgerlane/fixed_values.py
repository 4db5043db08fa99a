"""Word lists, limits and tables whose content decides the results.

Everything here is data.  The values are stated plainly and in their natural
order because results depend on them; no logic lives in this module.
"""

# --- metric catalog (fixed values): table, column, label, paired growth column, aliases
METRICS = (
    ("income_sheet", "total_profit", "利润总额", "total_profit_yoy_growth", ("利润总额",)),
    ("income_sheet", "net_profit", "净利润", "net_profit_yoy_growth", ("净利润", "利润")),
    ("income_sheet", "main_business_revenue", "主营业务收入", "main_business_revenue_yoy_growth", ("主营业务收入",)),
    ("income_sheet", "total_operating_revenue", "营业总收入", "operating_revenue_yoy_growth", ("营业总收入", "营业收入", "销售额")),
    ("income_sheet", "operating_expense_rnd_expenses", "研发费用", None, ("研发费用",)),
    ("income_sheet", "operating_expense_selling_expenses", "销售费用", None, ("销售费用",)),
    ("income_sheet", "operating_expense_administrative_expenses", "管理费用", None, ("管理费用",)),
    ("income_sheet", "operating_expense_financial_expenses", "财务费用", None, ("财务费用",)),
    ("income_sheet", "operating_expense_taxes_and_surcharges", "税金及附加", None, ("税金及附加",)),
    ("income_sheet", "total_operating_expenses", "营业总支出", None, ("营业总支出",)),
    ("balance_sheet", "asset_cash_and_cash_equivalents", "货币资金", None, ("货币资金",)),
    ("balance_sheet", "asset_accounts_receivable", "应收账款", None, ("应收账款",)),
    ("balance_sheet", "asset_inventory", "存货", None, ("存货",)),
    ("balance_sheet", "asset_total_assets", "总资产", "asset_total_assets_yoy_growth", ("总资产", "资产总额")),
    ("balance_sheet", "liability_total_liabilities", "负债总额", "liability_total_liabilities_yoy_growth", ("负债总额", "总负债")),
    ("balance_sheet", "asset_liability_ratio", "资产负债率", None, ("资产负债率",)),
    ("balance_sheet", "equity_parent_net_assets", "归母净资产", None, ("归母净资产", "归属于上市公司股东的净资产", "归属于母公司股东的净资产")),
    ("core_performance_indicators_sheet", "eps", "基本每股收益", None, ("基本每股收益", "每股收益")),
    ("core_performance_indicators_sheet", "diluted_eps", "稀释每股收益", None, ("稀释每股收益",)),
    ("core_performance_indicators_sheet", "operating_revenue_yoy_growth", "营业总收入同比增长率", None, ("营业总收入同比增长率", "营业总收入同比增长")),
    ("core_performance_indicators_sheet", "operating_revenue_qoq_growth", "营业总收入环比增长率", None, ("营业总收入环比增长率", "营业总收入季度环比增长")),
    ("core_performance_indicators_sheet", "net_profit_yoy_growth", "净利润同比增长率", None, ("净利润同比增长率", "净利润同比增长")),
    ("core_performance_indicators_sheet", "net_profit_qoq_growth", "净利润环比增长率", None, ("净利润环比增长率", "净利润季度环比增长")),
    ("core_performance_indicators_sheet", "gross_profit_margin", "销售毛利率", None, ("销售毛利率",)),
    ("core_performance_indicators_sheet", "net_profit_margin", "销售净利率", None, ("销售净利率",)),
    ("core_performance_indicators_sheet", "roe", "加权平均净资产收益率", None, ("净资产收益率", "加权平均净资产收益率")),
    ("core_performance_indicators_sheet", "roe_weighted_excl_non_recurring", "加权平均净资产收益率（扣非）", None, ("加权平均净资产收益率（扣非）", "加权平均净资产收益率(扣非)")),
    ("cash_flow_sheet", "operating_cf_net_amount", "经营活动现金流量净额", None, ("经营活动现金流量净额", "经营性现金流", "经营性现金流量净额")),
    ("cash_flow_sheet", "investing_cf_net_amount", "投资活动现金流量净额", None, ("投资活动现金流量净额", "投资性现金流量净额")),
    ("cash_flow_sheet", "financing_cf_net_amount", "筹资活动现金流量净额", None, ("筹资活动现金流量净额", "融资活动现金流量净额", "融资性现金流量净额")),
    ("cash_flow_sheet", "net_cash_flow", "净现金流", "net_cash_flow_yoy_growth", ("净现金流",)),
)

# --- company attribute aliases (fixed values): alias, column, label
COMPANY_FIELDS = (
    ("员工人数", "employee_count", "员工人数"),
    ("雇员人数", "employee_count", "员工人数"),
    ("管理人员人数", "management_count", "管理人员人数"),
    ("注册资本", "registered_capital", "注册资本"),
    ("上市交易所", "listed_exchange", "上市交易所"),
    ("所属行业", "industry", "所属证监会行业"),
    ("行业", "industry", "所属证监会行业"),
    ("英文名称", "english_name", "英文名称"),
    ("公司名称", "company_name", "公司名称"),
)

# --- company master headers (fixed values): source header -> column
COMPANY_HEADERS = (
    ("序号", "serial_number"),
    ("股票代码", "stock_code"),
    ("A股简称", "stock_abbr"),
    ("公司名称", "company_name"),
    ("英文名称", "english_name"),
    ("所属证监会行业", "industry"),
    ("上市交易所", "listed_exchange"),
    ("证券类别", "security_type"),
    ("注册区域", "registered_region"),
    ("注册资本", "registered_capital"),
    ("雇员人数", "employee_count"),
    ("管理人员人数", "management_count"),
)

# --- statement tables (fixed values)
STATEMENT_TABLES = (
    "income_sheet",
    "core_performance_indicators_sheet",
    "balance_sheet",
    "cash_flow_sheet",
)

# dictionary type prefix -> column type, first hit wins (fixed values)
TYPE_PREFIXES = (
    ("int", "bigint"),
    ("bigint", "bigint"),
    ("decimal", "double"),
    ("float", "double"),
    ("double", "double"),
    ("varchar", "string"),
    ("char", "string"),
    ("text", "string"),
    ("date", "string"),
    ("datetime", "string"),
)

COMMON_COLUMNS = (
    ("serial_number", "bigint"),
    ("stock_code", "string"),
    ("stock_abbr", "string"),
    ("report_period", "string"),
)

EXTRA_COLUMNS = {
    "income_sheet": (
        ("total_profit", "double"),
        ("total_profit_yoy_growth", "double"),
        ("main_business_revenue", "double"),
        ("main_business_revenue_yoy_growth", "double"),
        ("source_file", "string"),
        ("source_excerpt", "string"),
    ),
    "core_performance_indicators_sheet": (
        ("diluted_eps", "double"),
        ("source_file", "string"),
        ("source_excerpt", "string"),
    ),
    "balance_sheet": (
        ("equity_parent_net_assets", "double"),
        ("source_file", "string"),
        ("source_excerpt", "string"),
    ),
    "cash_flow_sheet": (
        ("source_file", "string"),
        ("source_excerpt", "string"),
    ),
}

ROW_METADATA = (
    "stock_code", "stock_abbr", "report_period", "report_year",
    "report_date", "source_file", "source_excerpt", "serial_number",
)

CRITICAL_FIELDS = {
    "income_sheet": ("total_operating_revenue", "main_business_revenue", "net_profit", "total_profit"),
    "core_performance_indicators_sheet": ("eps", "diluted_eps", "roe"),
    "balance_sheet": (
        "asset_total_assets", "asset_cash_and_cash_equivalents", "asset_accounts_receivable",
        "asset_inventory", "equity_parent_net_assets",
    ),
    "cash_flow_sheet": ("operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount"),
}

KEY_LINEAGE_FIELDS = (
    "total_operating_revenue", "main_business_revenue", "net_profit", "total_profit",
    "operating_cf_net_amount", "asset_total_assets", "equity_parent_net_assets",
    "eps", "diluted_eps", "roe",
)

# --- data-quality limits (fixed values), money in 10k units
AMOUNT_LIMITS = {
    "total_operating_revenue": 30_000_000.0,
    "main_business_revenue": 30_000_000.0,
    "net_profit": 5_000_000.0,
    "total_profit": 5_000_000.0,
    "asset_total_assets": 40_000_000.0,
    "asset_cash_and_cash_equivalents": 8_000_000.0,
    "asset_accounts_receivable": 8_000_000.0,
    "asset_inventory": 8_000_000.0,
    "liability_total_liabilities": 35_000_000.0,
    "equity_parent_net_assets": 20_000_000.0,
    "operating_cf_net_amount": 8_000_000.0,
    "investing_cf_net_amount": 8_000_000.0,
    "financing_cf_net_amount": 8_000_000.0,
}
EPS_COLUMNS = ("eps", "diluted_eps", "net_asset_per_share", "operating_cf_per_share")
NON_NEGATIVE_COLUMNS = (
    "total_operating_revenue", "main_business_revenue", "asset_total_assets",
    "asset_cash_and_cash_equivalents", "asset_accounts_receivable", "asset_inventory",
    "equity_parent_net_assets",
)
COMPONENT_TOTALS = {
    "main_business_revenue": "total_operating_revenue",
    "asset_cash_and_cash_equivalents": "asset_total_assets",
    "asset_accounts_receivable": "asset_total_assets",
    "asset_inventory": "asset_total_assets",
    "equity_parent_net_assets": "asset_total_assets",
}
GROWTH_BASES = {
    "net_profit_yoy_growth": "net_profit",
    "operating_revenue_yoy_growth": "total_operating_revenue",
    "main_business_revenue_yoy_growth": "main_business_revenue",
    "total_profit_yoy_growth": "total_profit",
    "asset_total_assets_yoy_growth": "asset_total_assets",
    "liability_total_liabilities_yoy_growth": "liability_total_liabilities",
}
CASH_FLOW_COLUMNS = ("operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount")
RATIO_COLUMNS = (
    "net_profit_yoy_growth", "operating_revenue_yoy_growth", "main_business_revenue_yoy_growth",
    "total_profit_yoy_growth", "asset_total_assets_yoy_growth",
    "liability_total_liabilities_yoy_growth", "net_cash_flow_yoy_growth", "asset_liability_ratio",
    "gross_profit_margin", "net_profit_margin", "roe", "roe_weighted_excl_non_recurring",
    "operating_revenue_qoq_growth", "net_profit_qoq_growth",
)
PEER_MIN_COUNT = 4
PEER_P90_FACTOR = 8.0
PEER_MEDIAN_FACTOR = 12.0
PEER_FLOOR_DEFAULT = 500.0
PEER_FLOORS = {
    "total_operating_revenue": 1500.0,
    "main_business_revenue": 1500.0,
    "net_profit": 200.0,
    "total_profit": 200.0,
    "asset_total_assets": 2500.0,
    "operating_cf_net_amount": 300.0,
    "investing_cf_net_amount": 300.0,
    "financing_cf_net_amount": 300.0,
}
AMOUNT_HISTORY_DEFAULT = 15.0
AMOUNT_HISTORY_FACTORS = {
    "total_operating_revenue": 12.0,
    "main_business_revenue": 12.0,
    "net_profit": 10.0,
    "total_profit": 10.0,
    "asset_total_assets": 8.0,
    "operating_cf_net_amount": 10.0,
    "investing_cf_net_amount": 10.0,
    "financing_cf_net_amount": 10.0,
}
RATIO_HISTORY_DEFAULT = 8.0
RATIO_HISTORY_FACTORS = {"roe": 6.0, "asset_liability_ratio": 4.0, "diluted_eps": 6.0}
MAX_ABS_RATIO = 300.0
MAX_ABS_EPS = 20.0
MAX_ABS_ROE = 80.0
MAX_DISPLAY_GROWTH = 500.0
MAX_RAW_AMOUNT = 1e15

# --- income growth pairs (fixed values)
INCOME_GROWTH = (
    ("total_operating_revenue", "operating_revenue_yoy_growth"),
    ("main_business_revenue", "main_business_revenue_yoy_growth"),
    ("net_profit", "net_profit_yoy_growth"),
    ("total_profit", "total_profit_yoy_growth"),
)

# --- report periods (fixed values): wording -> code, applied in this order
PERIOD_WORDS = (
    ("年年度", "FY"), ("半年报", "HY"), ("半年度", "HY"), ("年度", "FY"), ("年报", "FY"),
    ("第一季度", "Q1"), ("一季度", "Q1"), ("第二季度", "Q2"), ("二季度", "Q2"),
    ("第三季度", "Q3"), ("三季度", "Q3"), ("第四季度", "Q4"), ("四季度", "Q4"), ("年", ""),
)
QUESTION_PERIODS = (
    ("Q1", "第一季度", ("第一季度", "一季度", "Q1", "q1")),
    ("Q2", "第二季度", ("第二季度", "二季度", "Q2", "q2")),
    ("Q3", "第三季度", ("第三季度", "三季度", "Q3", "q3")),
    ("Q4", "第四季度", ("第四季度", "四季度", "Q4", "q4")),
    ("HY", "半年度", ("半年度报告", "半年报", "半年度", "半年")),
)
TITLE_PERIODS = (
    ("Q1", ("第一季度报告", "一季度报告")),
    ("Q2", ("第二季度报告", "二季度报告")),
    ("Q3", ("第三季度报告", "三季度报告")),
    ("HY", ("半年度报告", "半年度报告摘要", "半年")),
    ("FY", ("年度报告",)),
)
PERIOD_RANK = (("Q1", 1), ("Q2", 2), ("HY", 2), ("Q3", 3), ("Q4", 4), ("FY", 5), ("E", 6))

# --- question keywords (fixed values)
CAUSE_WORDS = ("原因", "主要系", "受益于", "由于", "驱动", "带动", "推动", "导致", "增长", "提升", "恢复", "改善")
CHART_WORDS = ("可视化", "绘图", "图表", "折线图", "柱状图")
TREND_WORDS = ("趋势", "变化", "情况")
TREND_YEARS = "近[一二三四五六七八九0-9]+年"
ATTRIBUTION_WORDS = ("原因", "归因", "为什么", "为何")
LATEST_WORDS = ("最新", "最近一期", "最近一季", "当前")
RESEARCH_WORDS = ("研报", "评级", "券商")
INDUSTRY_WORDS = ("医保", "目录", "谈判", "中药", "行业")
PRODUCT_WORDS = ("新增", "产品", "哪些")
FOLLOW_UP_WORDS = ("那", "那么", "这个", "这些", "其中", "这家", "该公司", "它", "其", "继续", "呢")
RANKING_WORDS = ("排名", "前", "top", "topk")
YOY_WORDS = ("同比", "增速", "增幅", "增长率", "较上年", "比上年")
MAX_WORDS = ("最大", "最高", "最多")
MIN_WORDS = ("最小", "最低", "最少")
CONNECTOR_WORDS = ("同时", "以及", "并且", "并说明", "并分析", "并解释", "并给出", "并指出", "分别")
COMPANY_SET_WORDS = ("其中", "里面", "这些公司里", "这些企业里", "前十企业里", "那些公司里")
COMPARE_WORDS = ("比较", "对比", "对照")
THRESHOLD_WORDS = ("满足", "超过", "高于", "低于", "不超过", "不低于", "大于", "小于")
MAX_GROWTH_WORDS = ("同比增幅最大", "增长最快", "增幅最大", "上涨最多")
LISTING_WORDS = ("列出", "列举", "找出", "哪些公司", "哪些企业")
CROSS_COMPANY_WORDS = (
    "哪些企业", "哪些公司", "公司有哪些", "企业有哪些", "排名", "前五", "前十", "top",
    "超过", "高于", "低于", "少于", "不低于", "不少于", "不超过",
)
FOLLOW_UP_ENDINGS = ("呢", "吗", "？", "?")
FOLLOW_UP_STARTS = ("那", "它", "这", "其")
PRODUCT_QUESTION_GROUPS = (
    ("医保", "目录", "谈判"), ("产品", "药品", "哪些", "名单"), ("中药", "中成药"), ("新增", "新进", "纳入"),
)
HERBAL_WORDS = ("中药", "中成药")
DRAW_WORDS = ("绘图", "画图", "可视化", "图表")
THEN_WORDS = ("再", "然后")
PERCENT_LABEL_WORDS = ("率", "同比", "环比", "占比")
REWRITES = (
    ("(?:谁|哪家|哪个公司).*(?:增长最快|增幅最大|上涨最多|同比最高)", "同比增幅最大"),
    ("(?:近几年|近三年|近五年).*(?:趋势|变化).*(?:原因|分析原因|解释原因)", "趋势 并分析原因"),
    ("(?:列出|找出|筛选).*(?:公司|企业).*(?:比较|对比).*(?:同比|增幅)", "列出企业 并比较同比"),
    ("(?:哪些|哪些公司).*(?:满足|超过|高于|低于).*(?:最高|最低|最大|最小)", "阈值筛选 并 找最高最低"),
    ("(?:先|先把).*(?:绘图|画图|可视化).*(?:再|然后).*(?:解释|分析|原因)", "趋势绘图 并 分析原因"),
)
SET_PHRASES = (("这些公司里", "企业", "这些企业里"), ("里面", "其中", "其中"))
INTENTS = ("ranking", "single_value", "yoy", "maxmin", "trend", "attribution")

# threshold wording (fixed values): negated forms are tested first
THRESHOLD_FORMS = (
    (">=", "不少于|不低于|>="),
    ("<=", "不超过|不高于|<="),
    (">", "超过|高于|大于|>"),
    ("<", "低于|少于|小于|<"),
)

# --- question labels (fixed values)
QUESTION_LABELS = (
    "数据基本查询", "数据统计分析查询", "多意图", "意图模糊", "归因分析", "开放性问题", "融合查询", "数据校验",
)
PRIMARY_LABELS = (
    "数据校验", "融合查询", "开放性问题", "归因分析", "意图模糊", "多意图", "数据统计分析查询", "数据基本查询",
)
LABEL_ANALYSIS_WORDS = (
    "趋势", "变化", "同比", "环比", "占比", "排名", "排行", "top", "前五", "前十", "最高", "最低",
    "均值", "平均", "对比", "比较", "波动", "可视化", "绘图", "图表", "画图", "统计", "分析",
    "近一年", "近两年", "近三年", "近五年",
)
LABEL_TREND_YEARS = "近[一二三四五六七八九十0-9]+年"
LABEL_CAUSE_WORDS = ("原因", "为什么", "为何", "评因", "驱动", "推动", "影响因素", "导致")
LABEL_OPEN_WORDS = ("评价", "看法", "怎么看", "如何看待", "建议", "展望", "风险", "机会", "总结", "概括", "解读", "判断", "亮点")
LABEL_FUSION_WORDS = ("结合", "综合", "融合", "联合", "交叉", "同时参考", "多源", "财报和研报", "结合财报", "结合研报")
LABEL_VALIDATION_WORDS = ("校验", "校核", "核对", "核验", "验证", "一致", "是否一致", "是否匹配", "差异", "勾稽", "比对", "检查")
LABEL_AMBIGUOUS_WORDS = ("最近", "都有哪些", "有哪些", "哪些", "什么情况", "表现如何", "怎么样")
LABEL_SOURCE_WORDS = ("财报", "研报")
SCOPES = ("系统生成", "官方题库", "自定义问题")

# --- question templates (fixed values): declared label, title, questions
QUESTION_TEMPLATES = (
    ("数据基本查询", "基础信息直查", ("{company}的员工人数是多少",)),
    ("数据基本查询", "年度核心指标直查", ("{company}{year}年的{profit}是多少",)),
    ("数据统计分析查询", "近三年趋势绘图", ("{company}近三年的{revenue}情况做可视化绘图",)),
    ("数据统计分析查询", "排名与统计分析", ("{year}年利润最高的top5企业是哪些",)),
    ("多意图", "趋势与归因联合追问", ("{company}近三年的{revenue}情况做可视化绘图", "{company}{revenue}上升的原因是什么")),
    ("多意图", "指标组合查询", ("{company}{year}年的{profit}是多少", "{company}{year}年的{cash}是多少")),
    ("意图模糊", "模糊产品检索", ("最近国家医保目录新进的中药产品有哪些",)),
    ("意图模糊", "模糊研报检索", ("{company}最近都出了哪些研报",)),
    ("归因分析", "主营业务收入归因", ("{company}{revenue}上升的原因是什么",)),
    ("归因分析", "利润变化归因", ("{company}{profit}增长的原因是什么",)),
    ("开放性问题", "经营亮点与风险概括", ("结合{company}近三年的经营表现，概括其业务亮点与潜在风险",)),
    ("融合查询", "财报与研报融合问答", ("结合{company}近三年的{revenue}变化和研报观点，说明增长原因并总结主要依据",)),
    ("数据校验", "指标一致性核验", ("请核对{company}{year}年的{profit}在利润表和指标事实表中是否一致",)),
)
TEMPLATE_METRICS = {
    "revenue": ("main_business_revenue", "total_operating_revenue"),
    "profit": ("net_profit", "total_profit"),
    "cash": ("operating_cf_net_amount", "net_cash_flow"),
}
TEMPLATE_LABELS = {
    "net_profit": "净利润",
    "total_profit": "利润总额",
    "main_business_revenue": "主营业务收入",
    "total_operating_revenue": "营业总收入",
    "operating_cf_net_amount": "经营活动产生的现金流量净额",
    "net_cash_flow": "净现金流",
}

# --- company-name fragments (fixed values)
GENERIC_FRAGMENTS = ("公司", "股份", "有限", "集团", "药业", "医药", "制药", "生物", "科技")
LEGAL_FORMS = ("集团股份有限公司", "集团股份公司", "股份有限公司", "股份公司", "集团有限公司", "有限公司")
FRAGMENT_BLOCKERS = ("公司", "股份", "有限")

# --- retrieval (fixed values)
RETRIEVAL_STOP_WORDS = (
    "公司", "企业", "哪些", "什么", "为什么", "如何", "情况", "变化", "趋势", "分析", "原因", "上升", "下降", "增长", "研报",
)
SOURCE_TYPES = (
    "company_profile", "stock_research_meta", "industry_research_meta", "financial_report_pdf",
    "stock_research_pdf", "industry_research_pdf", "research_pdf",
)
CANDIDATE_ORDER = (
    ("stock_research_pdf", 1), ("stock_research_meta", 2), ("financial_report_pdf", 3),
    ("industry_research_pdf", 4), ("industry_research_meta", 5),
)
RESULT_ORDER = {
    "industry": (("industry_research_pdf", 1), ("industry_research_meta", 2), ("stock_research_pdf", 3), ("stock_research_meta", 4), ("financial_report_pdf", 5)),
    "cause": (("stock_research_pdf", 1), ("stock_research_meta", 2), ("financial_report_pdf", 3), ("industry_research_pdf", 4), ("industry_research_meta", 5)),
    "plain": (("stock_research_pdf", 1), ("financial_report_pdf", 2), ("stock_research_meta", 3), ("industry_research_pdf", 4), ("industry_research_meta", 5)),
}
SOURCE_WHITELIST = {
    "product": ("industry_research_pdf", "industry_research_meta"),
    "industry": ("industry_research_pdf", "industry_research_meta", "stock_research_pdf", "stock_research_meta"),
    "cause": ("stock_research_pdf", "stock_research_meta", "financial_report_pdf"),
    "research": ("stock_research_pdf", "stock_research_meta", "industry_research_pdf", "industry_research_meta"),
}
EXTRACTED_SOURCES = ("financial_report_pdf", "industry_research_pdf", "stock_research_pdf")
INDUSTRY_BONUS_WORDS = ("医保", "目录", "谈判", "新增")
INDUSTRY_SENTENCE_WORDS = ("医保", "目录", "谈判", "新增", "中药")
THEMES = (
    ("CHC业务回暖", ("CHC", "呼吸", "品牌", "回暖")),
    ("处方药业务逐步恢复", ("处方药", "集采", "恢复")),
    ("并购整合与并表贡献", ("昆药", "天士力", "并表", "融合")),
    ("新品放量和渠道改善", ("新品", "渠道", "库存", "益气清肺")),
)
MOJIBAKE = "îïìðñò�"

# --- statement extraction (fixed values)
REPORT_SIZE_LIMIT = 25_000_000
ROW_STOP_LABELS = (
    "营业总收入", "营业收入", "利润总额", "归属于上市公司股东的净利润", "归属于母公司股东的净利润",
    "归属于上市公司股东的扣除非经常性损益的净利润", "经营活动产生的现金流量净额", "基本每股收益",
    "稀释每股收益", "加权平均净资产收益率", "总资产", "归属于上市公司股东的净资产",
    "报告期分季度的主要会计数据", "分季度主要财务指标", "非经常性损益项目和金额", "单位：", "单位:",
)
PROFIT_STOP_LABELS = ROW_STOP_LABELS + (
    "减：所得税费用", "五、净利润", "净利润", "六、其他综合收益的税后净额", "七、综合收益总额",
)
ANNUAL_ANCHORS = ("近三年主要会计数据和财务指标", "主要会计数据和财务指标", "主要财务数据")
PERIODIC_ANCHORS = ("主要财务数据", "主要会计数据和财务指标")
QUARTER_ANCHORS = ("分季度主要财务指标", "报告期分季度的主要会计数据", "分季度主要财务数据")
PROFIT_ANCHORS = ("合并利润表", "合并年初到报告期末利润表")
REVENUE_LABELS = ("营业总收入", "营业收入")
NET_PROFIT_LABELS = ("归属于上市公司股东的净利润", "归属于母公司股东的净利润", "归属于母公司所有者的净利润")
EQUITY_LABELS = ("归属于上市公司股东的净资产", "归属于母公司股东的净资产", "归属于母公司所有者权益")
# rule: labels, window, unit, then (table, value column, growth column) targets.
ANNUAL_RULES = (
    (REVENUE_LABELS, 360, "money", (("income_sheet", "total_operating_revenue", "operating_revenue_yoy_growth"), ("income_sheet", "main_business_revenue", "main_business_revenue_yoy_growth"))),
    (("利润总额",), 320, "money", (("income_sheet", "total_profit", "total_profit_yoy_growth"),)),
    (NET_PROFIT_LABELS, 360, "money", (("income_sheet", "net_profit", "net_profit_yoy_growth"),)),
    (("经营活动产生的现金流量净额",), 320, "money", (("cash_flow_sheet", "operating_cf_net_amount", None),)),
    (("投资活动产生的现金流量净额",), 320, "money", (("cash_flow_sheet", "investing_cf_net_amount", None),)),
    (("筹资活动产生的现金流量净额",), 320, "money", (("cash_flow_sheet", "financing_cf_net_amount", None),)),
    (("基本每股收益", "每股收益"), 220, "plain", (("core_performance_indicators_sheet", "eps", None),)),
    (("稀释每股收益",), 220, "plain", (("core_performance_indicators_sheet", "diluted_eps", None),)),
    (("加权平均净资产收益率", "净资产收益率"), 220, "plain", (("core_performance_indicators_sheet", "roe", None),)),
    (("扣除非经常性损益后的加权平均净资产收益率", "加权平均净资产收益率（扣非）", "加权平均净资产收益率(扣非)"), 240, "plain", (("core_performance_indicators_sheet", "roe_weighted_excl_non_recurring", None),)),
    (("总资产",), 260, "money", (("balance_sheet", "asset_total_assets", "asset_total_assets_yoy_growth"),)),
    (("货币资金",), 240, "money", (("balance_sheet", "asset_cash_and_cash_equivalents", None),)),
    (("应收账款",), 240, "money", (("balance_sheet", "asset_accounts_receivable", None),)),
    (("存货",), 240, "money", (("balance_sheet", "asset_inventory", None),)),
    (("总负债", "负债总额"), 260, "money", (("balance_sheet", "liability_total_liabilities", "liability_total_liabilities_yoy_growth"),)),
    (("资产负债率",), 200, "plain", (("balance_sheet", "asset_liability_ratio", None),)),
    (EQUITY_LABELS, 280, "money", (("balance_sheet", "equity_parent_net_assets", None),)),
)
# periodic rules carry the row layout: "periodic" rows or "annual" rows
PERIODIC_RULES = (
    (REVENUE_LABELS, 320, "money", "periodic", (("income_sheet", "total_operating_revenue", "operating_revenue_yoy_growth"), ("income_sheet", "main_business_revenue", "main_business_revenue_yoy_growth"))),
    (("利润总额",), 280, "money", "periodic", (("income_sheet", "total_profit", "total_profit_yoy_growth"),)),
    (NET_PROFIT_LABELS, 320, "money", "periodic", (("income_sheet", "net_profit", "net_profit_yoy_growth"),)),
    (("经营活动产生的现金流量净额",), 280, "money", "periodic", (("cash_flow_sheet", "operating_cf_net_amount", None),)),
    (("投资活动产生的现金流量净额",), 280, "money", "periodic", (("cash_flow_sheet", "investing_cf_net_amount", None),)),
    (("筹资活动产生的现金流量净额",), 280, "money", "periodic", (("cash_flow_sheet", "financing_cf_net_amount", None),)),
    (("基本每股收益", "每股收益"), 220, "plain", "periodic", (("core_performance_indicators_sheet", "eps", None),)),
    (("稀释每股收益",), 220, "plain", "periodic", (("core_performance_indicators_sheet", "diluted_eps", None),)),
    (("加权平均净资产收益率", "净资产收益率"), 220, "plain", "periodic", (("core_performance_indicators_sheet", "roe", None),)),
    (("总资产",), 240, "money", "annual", (("balance_sheet", "asset_total_assets", None),)),
    (("货币资金",), 220, "money", "annual", (("balance_sheet", "asset_cash_and_cash_equivalents", None),)),
    (("应收账款",), 220, "money", "annual", (("balance_sheet", "asset_accounts_receivable", None),)),
    (("存货",), 220, "money", "annual", (("balance_sheet", "asset_inventory", None),)),
    (EQUITY_LABELS, 260, "money", "annual", (("balance_sheet", "equity_parent_net_assets", None),)),
    (("资产负债率",), 180, "plain", "annual", (("balance_sheet", "asset_liability_ratio", None),)),
)
QUARTER_RULES = (
    (("营业总收入", "营业收入"), "income_sheet", "total_operating_revenue", "年度分季度数据-营业总收入"),
    (("主营业务收入", "营业总收入", "营业收入"), "income_sheet", "main_business_revenue", "年度分季度数据-主营业务收入"),
    (NET_PROFIT_LABELS, "income_sheet", "net_profit", "年度分季度数据-净利润"),
    (("经营活动产生的现金流量净额",), "cash_flow_sheet", "operating_cf_net_amount", "年度分季度数据-经营活动现金流量净额"),
)
PROFIT_LABELS = ("四、利润总额", "利润总额")
ANNUAL_EXCERPT = "年度主要会计数据和财务指标"
PERIODIC_EXCERPT = "季度主要会计数据和财务指标"
PROFIT_EXCERPT = "利润表正文-利润总额"
REPORT_TITLE_WORDS = ("年度报告", "半年度报告", "季度报告", "一季度报告", "三季度报告")
SUMMARY_WORDS = ("摘要",)
REVISED_WORDS = ("修订版", "更正版", "更新后")
NOT_APPLICABLE = "不适用"
UNKNOWN_TEXT = "未知"
UNIT_CHARS = "年月日季度期次元股人家项页号"

# --- chunk sentence templates (fixed values)
PROFILE_SENTENCE = "{stock_abbr}（{stock_code}），公司全称为{company_name}。所属行业：{industry}。上市交易所：{listed_exchange}。注册资本：{registered_capital}。员工人数：{employee_count}。管理人员人数：{management_count}。"
STOCK_META_SENTENCE = "个股研报标题：{title}。股票：{stockName}（{stockCode}）。机构：{orgName}。发布日期：{publishDate}。评级：{emRatingName}。研究员：{researcher}。"
INDUSTRY_META_SENTENCE = "行业研报标题：{title}。行业：{industryName}。机构：{orgName}。发布日期：{publishDate}。评级：{emRatingName}。研究员：{researcher}。"

# --- export (fixed values)
EXPORT_HEADERS = {
    "task2": ("编号", "问题", "SQL查询语句", "图形格式", "回答"),
    "task3": ("编号", "问题", "SQL查询语句", "回答"),
}
LINE_CHART, BAR_CHART, NO_CHART = "折线图", "柱状图", "无"

# --- trend answers (fixed values); %s: company, periods, values
TREND_PATTERNS = (
    ("v_shape", "V型反转强波动走势"), ("inverted_v", "倒V型波动走势"), ("rising", "持续上升走势"),
    ("falling", "持续下降走势"), ("mixed", "波动走势"),
)
TREND_HEAD = "%s%s的%s呈“%s”"
TREND_NONE = "%s%s暂无可用趋势数据"
TREND_SINGLE = "%s%s目前仅有%s一期数据（%s）"
TREND_DECLINE = "%s至%s持续回落并在%s触底"
TREND_LOW = "%s为阶段低点"
TREND_LOW_VALUE = "%s为阶段低点（%s）"
TREND_HIGH_VALUE = "%s为阶段高点（%s）"
TREND_RECOVERY = (("steady", "此后持续修复至%s"), ("uneven", "此后震荡修复至%s"))
TREND_RECENT = (("improving", "%s至%s季度改善显著"), ("falling_back", "%s至%s季度主要表现为回落"))

# wording of rankings with growth and of extremes in a company set; fixed values
LEAST_WORDS = ("最低", "最小")
HIGHEST, LOWEST, GROWTH_WORD = "最高", "最低", "同比增幅"
GROWTH_NOT_KNOWN, GROWTH_NOT_APPLICABLE = "未知", "不适用"
GROWTH_BEST = "%s Top%d 企业中，%s同比增幅最高的是%s，为 %s%%。"
GROWTH_UNKNOWN = "%s Top%d 企业已列出，但当前可用同比数据不足。"
SET_EXTREME = "在上一轮命中的 %d 家公司里，%s%s%s%s的是%s，为 %s。"

# where blanks are taken out of a text, and where numbers printed without a gap are parted; fixed values
SPACED_PATTERNS = (
    r"(?<=[\x{4e00}-\x{9fff}])\s+(?=[\x{4e00}-\x{9fff}])",
    r"(?<=[A-Za-z])\s+(?=[A-Za-z])",
    r"(?<=\d)\s+(?=\d)",
    r"(?<=\d)\s+(?=[,.:%/])",
    r"(?<=[,.:/])\s+(?=\d)",
    r"(?<=[-+])\s+(?=\d)",
    rf"(?<=\d)\s+(?=[{UNIT_CHARS}])",
    rf"(?<=[{UNIT_CHARS}])\s+(?=\d)",
)
GLUED_NUMBER_PATTERNS = (
    r"(?<=\.\d{2})(?=[-+]?\d{1,3},)",
    r"(?<=\.\d{2})(?=[-+]?\d+\.\d{2,4}%?)",
    r"(?<=\.\d{2})(?=20\d{2}(?:\D|$))",
    r"(?<=\.\d{4})(?=[-+]?\d{1,3},)",
    r"(?<=\.\d{4})(?=[-+]?\d+\.\d{2,4}%?)",
    r"(?<=\.\d{4})(?=20\d{2}(?:\D|$))",
)
NUMBER_BOUNDARY_PATTERNS = (
    r"(?<=\.\d{2})(?=-?\d{1,3},)",
    r"(?<=\.\d{2})(?=-?\d+\.\d{2,4}%?)",
    r"(?<=\.\d{4})(?=-?\d{1,3},)",
    r"(?<=\.\d{4})(?=-?\d+\.\d{2,4}%?)",
    r"(?<=\.\d{2})(?=20\d{2}(?:\D|$))",
    r"(?<=\.\d{4})(?=20\d{2}(?:\D|$))",
    r"(?<=%)(?=-?\d)",
    r"(?<=\d)(?=20\d{2}年)",
)

# codes, names and days in file stems and texts; fixed values
STEM_CODE_AND_DAY = r"(\d{6})_(\d{8})"
STEM_NAME_AND_TITLE = r"^([^:：]+)[:：](.+)"
TEXT_CODE = r"证券代码[:：]?([0-9]{6})"
TEXT_NAME = r"证券简称[:：]?([A-Za-z0-9\x{4e00}-\x{9fff}]+)"
DATE_SERIAL = r"^(\d+)(?:\.0+)?$"

# how far retrieval looks (terms of a question, candidates of a company, of a focused and of any other question) and its wording; fixed values
RETRIEVAL_TERMS = 6
RETRIEVAL_LIMITS = (600, 400, 300)
THEME_SENTENCE = 180
LIST_MARK, NEW_MARK, THIN_MARK = "、", "新增", "不足"
EVIDENCE_NONE = "当前未检索到足够的离线证据。可以补充公司名称、报告期或指标后再提问。"
EVIDENCE_TITLES = "当前本地行业研报正文抽取不足，无法稳定列出完整产品名单。可先参考这些相关题名："
EVIDENCE_PRODUCT_TITLES = "当前本地研报正文抽取不足，无法稳定枚举“国家医保目录新增的中药产品”名单。当前可参考的证据来源为："
EVIDENCE_THIN = "当前检索到的离线证据不足以稳定支持归因分析。建议补充公司名称、报告期或更具体的指标后再提问。"
EVIDENCE_CAUSE = "结论：%s\n证据依据：%s"

# attribution of a metric: question put to retrieval, conclusion by growth, themes, and the closing words; fixed values
REVENUE_COLUMNS = ("main_business_revenue", "total_operating_revenue")
ATTRIBUTION_QUESTION = "%s %s 上升原因"
ATTRIBUTION_VALUE = "从结构化数据库看，%s%s的%s为%s"
ATTRIBUTION_UP, ATTRIBUTION_DOWN, ATTRIBUTION_GROWTH = "同比上升", "同比下降", "同比"
ATTRIBUTION_THEMES = "综合本地财报与研报证据，%s主营业务收入上升主要受%s驱动。"
ATTRIBUTION_THIN = " 当前离线证据不足以稳定支撑归因分析。"
ATTRIBUTION_EVIDENCE = "\n证据依据：\n"
