"""Word lists and parameters. Each can be given anew as an argument where it is used."""

from __future__ import annotations

# Scoring and chunking parameters by domain. The first is also the default for unknown domains.
DOMAINS = {
    "financial_contracts": {"max_chars": 1500, "overlap": 200, "min_chars": 100, "k1": 2.0, "b": 0.5, "numeric": 25.0, "rating": 12.0, "entity": 5.0, "table_boost": 1.3, "top_k": 12, "files": r"text\d{2}\.json"},
    "financial_reports": {"max_chars": 2000, "overlap": 300, "min_chars": 150, "k1": 1.5, "b": 0.7, "numeric": 15.0, "rating": 10.0, "entity": 5.0, "table_boost": 2.0, "top_k": 15, "files": r"annual_.*\.json"},
    "insurance": {"max_chars": 800, "overlap": 100, "min_chars": 50, "k1": 2.0, "b": 0.3, "numeric": 15.0, "rating": 10.0, "entity": 8.0, "table_boost": 1.2, "top_k": 10, "files": r"\d+\.json"},
    "regulatory": {"max_chars": 1000, "overlap": 150, "min_chars": 80, "k1": 1.8, "b": 0.4, "numeric": 20.0, "rating": 10.0, "entity": 6.0, "table_boost": 1.2, "top_k": 12, "files": r"(csrc|strict_v3).*\.json"},
    "research": {"max_chars": 1200, "overlap": 200, "min_chars": 100, "k1": 1.6, "b": 0.6, "numeric": 20.0, "rating": 10.0, "entity": 5.0, "table_boost": 1.5, "top_k": 12, "files": r"pack2_text.*\.json"},
}
#: Of the plain (not domain) scoring.
BASE_K1, BASE_B, TABLE_BONUS = 1.8, 0.6, 5.0

# Words left out of queries and keys.
STOPWORDS = ("的", "了", "在", "是", "有", "和", "与", "或", "及", "其中", "一份", "第二份", "文档", "文件", "以下", "下列", "描述", "说法", "选项", "关于", "涉及", "包含", "明确", "公司", "规定", "应当")

# Aliases too general to expand.
GENERIC_ALIASES = (
    "发行人", "本公司", "本集团", "公司", "上市公司", "发行主体", "本次债券", "本次发行", "本次公司债券", "本期债券", "本期发行", "本期公司债券", "报告期", "报告期内", "报告期各期末",
    "最近三年及一期", "最近三年", "释义项", "释义内容", "重大事项", "基本情况", "注", "债务人", "债权人", "甲方", "乙方", "丙方", "丁方", "标的", "标的资产", "标的股权", "标的股份",
    "审计机构", "会计师事务所", "律师", "评级机构", "主承销商", "联席主承销商", "簿记管理人", "受托管理人", "债券持有人", "投资人",
)

# Phrases that add 40 to a chunk.
STRONG_PHRASES = (
    "研发投入合计", "研发投入总额", "研发投入金额", "研发投入资本化", "研发投入占营业收入比例", "研发费用占营业收入比例", "研发投入总额占营业收入比例", "资本化研发投入占研发投入",
    "市场规模", "市场空间", "金融信创市场规模", "受托管理人", "牵头主承销商", "簿记管理人", "发行规模", "发行总额", "募集资金总额", "募集资金净额", "项目总投资额", "项目投资总额", "拟投入募集资金",
    "资产负债率", "经营活动产生的现金流量净额", "归母净利润", "归属于上市公司股东的净利润", "营业收入", "净利润", "营业总收入", "分红比例", "每10股派息", "票面利率", "债券期限", "还本付息",
    "身故保险金", "现金价值", "犹豫期", "免责条款", "责任免除", "施行日期", "保存期限", "保存十年", "客户身份资料", "交易记录", "调任", "无需提交变更申请", "非银行支付机构",
    "AI光模块", "光模块市场规模", "云服务厂商资本开支", "CPO方案", "价值量占比", "贴片", "引线键合", "耦合", "封装", "测试",
)

# Headings that mark a noise section, by domain.
NOISE_HEADINGS = {
    "financial_contracts": ("重要提示", "目录", "释义", "公司简介", "前言", "声明", "备查文件", "重大事项提示"),
    "financial_reports": ("重要提示", "目录", "释义", "公司简介", "前言", "声明", "备查文件", "财务报表附注", "股东大会"),
    "insurance": ("重要提示", "目录", "释义", "前言", "声明", "备查文件", "条款目录"),
    "regulatory": ("目录", "前言", "总则", "附则", "声明", "备查文件", "立法宗旨"),
    "research": ("目录", "免责声明", "分析师声明", "评级说明", "重要声明", "风险提示"),
}

# Names and codes of companies.
ALIASES = {
    "比亚迪": "比亚迪股份有限公司", "宁德时代": "宁德时代新能源科技股份有限公司", "美的": "美的集团股份有限公司", "美的集团": "美的集团股份有限公司", "中国建筑": "中国建筑股份有限公司",
    "中国移动": "中国移动通信集团有限公司", "招商银行": "招商银行股份有限公司", "广晟控股": "广东省广晟控股集团有限公司", "深圳投控": "深圳市投资控股有限公司",
    "宏济堂": "山东宏济堂制药集团股份有限公司", "力诺集团": "力诺投资控股集团有限公司",
    "002594": "比亚迪股份有限公司", "300750": "宁德时代新能源科技股份有限公司", "000333": "美的集团股份有限公司", "601668": "中国建筑股份有限公司", "600941": "中国移动通信集团有限公司", "600036": "招商银行股份有限公司",
}
# Everyday words for metrics and their terms.
METRIC_SYNONYMS = {
    "营收": ("营业收入", "营业总收入", "营业额"), "营业收入": ("营业总收入", "营业额"), "净利": ("净利润", "归母净利润", "归属于母公司股东的净利润"),
    "净利润": ("归母净利润", "归属于母公司股东的净利润", "归属于上市公司股东的净利润"), "归母净利润": ("归属于母公司股东的净利润", "归属于上市公司股东的净利润"),
    "净资产收益率": ("加权平均净资产收益率",), "ROE": ("加权平均净资产收益率", "净资产收益率"), "EPS": ("基本每股收益", "每股收益"), "每股收益": ("基本每股收益",), "负债率": ("资产负债率",),
    "毛利率": ("销售毛利率",), "现金流量净额": ("经营活动产生的现金流量净额",), "经营现金流": ("经营活动产生的现金流量净额",), "扣非净利润": ("扣除非经常性损益的净利润",), "总资产": ("资产总计", "资产合计"),
    "净资产": ("所有者权益", "股东权益"), "研发投入": ("研发费用",), "市场占有率": ("市场份额", "市占率"), "市占率": ("市场占有率", "市场份额"), "同比增长": ("同比增加", "同比上升", "较上年同期"),
    "同比": ("较上年同期", "比上年同期"), "复合增长率": ("年复合增长率", "CAGR"), "出货量": ("销量", "装机量"), "目标价": ("目标价格",), "渗透率": ("市场渗透率",),
    "保额": ("基本保额", "保险金额"), "保费": ("保险费",), "犹豫期": ("冷静期", "撤销期"), "免赔额": ("免赔额", "赔付门槛"),
}

# Words that stand for others within a domain.
DOMAIN_SYNONYMS = {
    "financial_contracts": {
        "违约": ("违约责任", "违约金", "逾期利息", "惩罚性赔偿", "违约情形"), "赎回": ("有条件赎回", "强制赎回", "赎回条款", "提前赎回"), "回售": ("回售选择权", "投资人回售", "回售条款"),
        "转股": ("转股价格", "向下修正", "转股期限", "初始转股价"), "评级": ("主体信用评级", "债项评级", "AAA", "AA+", "AA"), "发行": ("发行金额", "发行规模", "募集金额", "注册金额"),
        "担保": ("增信", "担保", "保证", "质押", "抵押"), "兑付": ("兑付日", "付息日", "到期日", "兑付安排"), "中介": ("受托管理人", "主承销商", "保荐机构", "簿记管理人"),
    },
    "financial_reports": {
        "营收": ("营业收入", "营业总收入", "主营收入", "营收"), "利润": ("净利润", "归母净利润", "归属于母公司", "归属于上市公司股东", "利润总额", "营业利润"), "资产": ("总资产", "资产合计", "净资产", "归属于母公司股东权益"),
        "现金流": ("经营现金流", "经营活动产生的现金流量净额", "筹资活动", "投资活动"), "每股": ("每股收益", "每股净资产", "每股股利", "每股分红"), "研发": ("研发投入", "研发费用", "研发占比", "研发投入占营业收入"),
        "分红": ("现金分红", "利润分配", "股利分配", "每10股派"), "增速": ("同比增长", "同比下降", "同比", "增速", "增长率"),
    },
    "insurance": {
        "犹豫期": ("犹豫期", "冷静期", "撤销期"), "等待期": ("等待期", "观察期", "免赔期"), "免赔额": ("免赔额", "起付线", "免赔"), "赔付": ("赔付", "给付", "报销", "理赔"), "保险责任": ("保险责任", "保障范围", "承保范围"),
        "责任免除": ("责任免除", "免责条款", "除外责任", "不承担"), "现金价值": ("现金价值", "退保金", "解约金"), "保单贷款": ("保单贷款", "借款", "贷款比例"), "宽限期": ("宽限期", "续期", "续保"), "退保": ("退保", "解除合同", "终止合同"),
        "重疾险": ("重大疾病", "重疾", "安佑福"), "医疗险": ("医疗", "e生保", "百万医疗"), "意外险": ("意外", "营运交通", "预防接种"), "家财险": ("家财", "家庭财产", "房屋"), "寿险": ("寿险", "智盈金生", "增益宝", "富鸿金生"),
    },
    "regulatory": {
        "反洗钱": ("反洗钱", "客户身份识别", "受益所有人", "可疑交易", "大额交易"), "信息披露": ("信息披露", "定期报告", "临时报告", "董事会审议", "对外披露"), "上市公司": ("上市公司治理", "独立董事", "股东大会", "股东会", "董事会"),
        "证券公司": ("证券公司分类", "分类评价", "风险覆盖率"), "银行卡": ("银行卡清算", "清算机构", "分支机构"), "支付机构": ("非银行支付", "支付机构", "收费标准"), "数据安全": ("数据安全", "核心数据", "高敏感性数据"),
    },
    "research": {
        "市场规模": ("市场规模", "市场容量", "市场总额", "总规模"), "增速": ("复合增速", "增长率", "同比", "CAGR", "复合年增长率"), "份额": ("市场份额", "市占率", "占比"), "预测": ("预计", "预测", "展望", "前景"), "估值": ("PE", "PB", "估值", "市盈率", "市净率"),
        "金融科技": ("金融科技", "信创", "银行IT", "金融信息化"), "光通信": ("光通信", "光模块", "光器件"), "新能源": ("新能源", "电动车", "锂电池", "碳酸锂", "宁德时代"), "保险": ("银保渠道", "寿险", "保费"), "网络安全": ("网络安全", "安全运营", "等保"), "芯片": ("芯片", "芯原", "IP授权", "芯片设计"),
    },
}

# Phrases of a refusal, in citation checks and in answer metrics; hints of a question without an answer.
REFUSALS = ("文档中未提及", "文档未提及", "文档中没有提到", "文档中找不到", "未找到相关证据", "无法从文档", "证据不足，无法", "均无证据支持")
OUTPUT_REFUSALS = ("文档中未提及", "文档未提及", "文档中没有", "未找到相关证据", "无法从文档", "证据不足")

# Metric words of the symbol index.
SYMBOL_METRICS = (
    "营业收入", "净利润", "总资产", "净资产", "负债率", "资产负债率", "现金流", "研发费用", "毛利率", "净利率", "ROE", "ROA", "每股收益", "市盈率", "市净率", "分红", "派息", "保险金", "保费", "赔付",
    "免赔额", "等待期", "利率", "费率", "注册资本", "资本充足率", "经营活动", "投资活动", "筹资活动", "归母净利润", "扣非净利润", "基本每股收益",
)
# Metric words of entity extraction.
ENTITY_METRICS = (
    "营业收入", "净利润", "总资产", "净资产", "现金流", "毛利率", "净利率", "资产负债率", "ROE", "ROA", "每股收益", "市盈率", "市净率", "股息率", "研发投入", "研发费用", "研发费用率", "研发占比",
    "资本充足率", "不良贷款率", "拨备覆盖率", "偿付能力", "综合成本率", "已赚保费", "退保率", "现金价值", "身故保险金", "满期保险金", "年金", "归属于上市公司股东的净利润", "归母净利润",
    "经营活动产生的现金流量净额", "经营活动现金流", "投资活动产生的现金流量净额", "投资活动现金流", "筹资活动产生的现金流量净额", "筹资活动现金流", "新签合同额", "合同负债", "基本每股收益", "稀释每股收益",
    "加权平均净资产收益率", "归属于上市公司股东的净资产", "主营业务收入", "其他业务收入", "营业成本", "销售费用", "管理费用", "财务费用", "每股股利", "每10股", "分红", "派息",
)

# Weights of question types in the overall score.
TYPE_WEIGHTS = {"mcq": 1.0, "multi": 1.5, "logical": 1.5, "calc": 2.0}

# Words that a dictionary segmenter keeps whole, besides years and amounts of units (see extract.by_dictionary).
DICTIONARY = (
    "股份有限公司", "有限公司", "有限责任公司", "集团有限公司", "有限合伙人", "有限合伙",
    "招商银行", "中国银行", "工商银行", "建设银行", "交通银行", "兴业银行", "浦发银行", "平安银行", "厦门银行", "招商永隆银行", "商业银行", "中央银行", "上市银行",
    "国信证券", "西部证券", "东方证券", "中泰证券", "国盛证券", "华创证券", "中原证券", "证券交易所", "证券投资基金", "中国证券报", "上海证券报", "深圳证券交易所",
    "新华保险", "中国人寿", "中国平安", "平安人寿", "平安财产", "养老保险", "人寿保险", "财产保险", "医疗保险", "工伤保险", "生育保险", "失业保险", "社会保险", "商业养老保险",
    "平安智盈金生", "专属商业养老保险", "保险责任", "保险期间", "保险事故", "保险合同", "保险费", "保险金", "被保险人", "投保人", "受益人", "保险金申请人", "责任免除", "现金价值", "犹豫期", "等待期",
    "不承担赔偿责任", "不承担保险责任", "不承担给付保险金责任", "偿付能力", "充足率", "核心偿付能力充足率", "综合偿付能力充足率",
    "负债合计", "资产合计", "营业收入", "营业利润", "净利润", "净资产", "总资产", "应收账款", "坏账准备", "账面余额", "账面价值", "年末余额", "年初余额", "研发投入", "研发费用", "研发工程师", "同比上升", "同比下降",
    "手机部件", "汽车业务", "二次充电电池", "市场份额", "工业软件", "市场规模", "母公司拥有人", "应占溢利", "报告期内", "报告期各期末", "其他综合收益", "其他权益工具", "连带责任保证", "基础设施建设",
    "上市公司", "高级管理人员", "实际控制人", "控股股东", "信息披露", "信息披露义务", "行政监管措施", "行政法规", "对外担保", "管理制度", "独立董事", "董事会", "会计师事务所", "行政处罚", "定期报告", "临时报告", "公司法", "证券法",
    "银保渠道", "个险渠道", "银行竞争", "核心驱动力", "自营品", "首款", "标的公司", "控股子公司", "合营公司", "租赁项目公司", "归属于母公司", "归属于上市公司", "包括但不限于", "除另有约定外",
)
# Identifiers that stand for several documents.
COMPOSITES = {
    "multi": tuple(f"text{k:02d}" for k in range(4, 15)), "ins_multi_all": tuple(str(k) for k in range(1, 17)), "fr_multi_2025": ("annual_byd_2025_report",),
    "fr_multi_catl_midea": ("annual_catl_2025_report", "annual_midea_2025_report"), "fr_multi_3comp": ("annual_byd_2025_report", "annual_catl_2025_report", "annual_midea_2025_report"),
    "fr_multi_4comp": ("annual_byd_2025_report", "annual_catl_2025_report", "annual_midea_2025_report", "annual_chinamobile_2025_report", "annual_cmb_2025_report", "annual_cscec_2025_report"),
    "fr_multi_catl_midea_cmb_cscec": ("annual_catl_2025_report", "annual_midea_2025_report", "annual_cmb_2025_report", "annual_cscec_2025_report"), "fr_multi_byd_catl": ("annual_byd_2025_report", "annual_catl_2025_report"),
}
