"""Rule packs as data: words and patterns for Chinese market texts, and additions for the driver's tables, which hold no Chinese."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# Noise lines, noise paragraphs, sections and line markers of market reports.
NOISE_PATTERNS = (
    r"^https?://\S+$",
    r"^[=\-_]{3,}$",
    r"^[•·●○◆◇▪▸►▻]$",
    r"^[\[\]【】大中小\s]+$",
    r"^\d{1,2}\s*/\s*\d{1,2}$",
    r"^第[一二三四五六七八九十\d]+页$",
    r"^400[-\s]?\d{3}[-\s]?\d{4}$",
    r"^\d{3,5}-\d{6,8}$",
    r"^客服\s*[:：]\s*\d+$",
)
NOISE_WORDS = (
    "版权所有", "免责声明", "风险提示", "投资有风险", "市场有风险", "入市需谨慎", "期市有风险",
    "扫码关注", "添加微信", "加我微信", "QQ群", "微信号", "点击关注", "转发", "点赞", "在看", "分享",
    "关注我们", "订阅", "公众号", "广告", "二维码", "下载APP", "下载 APP", "APP下载",
    "客服电话", "咨询电话", "免费热线", "联系电话", "客服热线", "客服中心", "客服 :",
    "本报告仅供参考", "未经许可", "不得转载", "不得复制", "未经本公司允许", "不得以任何方式", "商标、服务标识",
    "不作任何保证", "不构成投资", "任何担保", "注明出处", "Copyright", "All Rights Reserved",
    "本报告中的信息", "本报告不构成", "本报告版权", "本观点其于", "本观点基于", "据此投资", "风险自负", "投资者据此操作",
    "无障碍浏览", "收藏本页面", "[打印]", "上一篇：", "下一篇：", "返回顶部", "相关信息", "浙公网安备", "ICP备案",
)
NOISE_PARAGRAPHS = ("免责声明", "免责申明", "风险提示[：:]", r"分析师\s*(?:声明|承诺|简介)", r"重要\s*(?:声明|事项|提示)", r"(?:法律|合规)\s*声明")
SECTION_FIELDS = {"正文文本": "body", "表格数据": "tables", "图片OCR文本": "ocr", "AI图表解读": "ai"}
HINTS = (
    "观点", "逻辑", "建议", "操作", "策略", "展望", "预测", "预计", "预期", "价格", "中枢", "上涨", "下跌", "上行", "下行", "偏强", "偏弱", "震荡",
    "库存", "需求", "供应", "成本", "利润", "基差", "现货", "期货", "产业链", "利多", "利空", "支撑", "压力", "风险", "关注", "产能", "装置", "负荷",
    "原油", "开工率", "投产",
)
CORE_HINTS = (
    "观点", "逻辑", "建议", "策略", "预计", "预期", "价格中枢", "震荡下行", "震荡上行", "偏强", "偏弱", "看涨", "看跌", "产能", "装置", "投产",
    "负荷", "需求", "供应", "库存", "成本", "原油", "基差", "压力",
)
JUDGEMENT_HINTS = (
    "观点", "逻辑", "建议", "预计", "预期", "有望", "看涨", "看跌", "偏强", "偏弱", "上行", "下行", "上涨", "下跌", "回落", "改善", "承压", "支撑",
    "维持", "关注", "风险", "震荡",
)
NAVIGATION = ("晨报", "日报", "周报", "月报", "年报", "农产品", "能源化工", "有色金属", "黑色金属", "金融期货", "商品期货", "股指期货", "国债期货", "交易策略")
DISCLAIMER_STARTS = (
    "期货有限公司是经中国证监会批准", "本刊所有信息均建立在可靠", "不构成买卖建议", "不构成任何投资建议", "未经书面许可", "研究报告不代表协会观点",
    "粤海街道", "金融大厦", "资产管理、期货交易咨询等业务资格", "本报告并不提供量身定制的交易建议", "版权声明", "复制本刊任何内容皆属违反版权法行为",
    "独立评估特定的交易", "专业财务顾问",
)
DISCLAIMER_MORE = (
    "商品期货经纪", "金融期货经纪", "资产管理", "期货交易咨询", "我们力求", "精确的数据", "客观的分析", "概不负责", "量身定制的交易建议", "财务状况及目标",
    "研究团队建议", "独立评估特定的交易", "专业财务顾问", "交易者自身的状况", "文中所提及", "仅供参考", "电子机械影印录音", "复制传播",
    "存储于任何检索系统", "违反版权法", "损失赔偿",
)
RESIDUAL_DISCLAIMERS = (
    "会计或税务", "最终操作建议", "任何担保", "本报告中使用", "所有在本报告", "免责条款", "免责声明", "不构成投资", "未经本公司允许", "商标服务标识",
    "准确性和完整性", "不构成买卖建议", "不构成任何投资建议", "未经书面许可", "研究报告不代表协会观点", "本刊所有信息均建立在可靠",
    "资产管理、期货交易咨询等业务资格", "本报告并不提供量身定制", "复制本刊任何内容皆属违反版权法行为", "独立评估特定的交易", "专业财务顾问",
)
SOURCE_MARKS = ("数据来源", "数据源", "数据未源", "数据床源", "数据订源", "更新频率")
SOURCE_CODES = r"(?i)\b(?:WIND|FIND|BIS|BRE|SUE|Bae|SORE|SG\d*)\b"
CHART_TITLES = ("货价格及价差", "基差及盘面价差", "上游利润及开工率", "下游利润及开工率", "持仓成交与仓单博")
CHART_TERMS = ("价格", "价差", "利润", "开工率", "持仓量", "成交量", "仓单", "基差", "日产量", "损失量", "区域价差")
TABLE_WORDS = (
    "库存管理", "库序管理", "库存优育", "有网管理", "终端宕户", "原料库存", "套保比例", "入场价格", "相关场外产品", "期权增强收益", "期祝增强收益",
    "控制采购成本", "锁定志出价格", "卖出看涨期权", "预防价格下跌", "款要PE原料", "焊f工生", "WEE",
)
FRAGMENT_TERMS = ("环比", "持仓", "注册仓", "合约", "现货市场", "收盘价", "价格")
DISPLAY_NOISE = ("免责声明", "免责申明", "免责条款", "版权声明", "未经书面许可", "不得转载", "不构成投资建议", "不构成买卖建议", "本报告由", "研究所团队完成", "以上文中涉及数据来自", "地址：", "联系人：")
BOILERPLATE = (
    "无障碍浏览", "客服电话", "公司概括", "公司简介", "组织架构", "股东信息", "营业执照", "经营许可证", "企业文化", "联系我们", "加入我们", "社会招聘",
    "校园招聘", "版权所有", "ICP备案", "首页", "网站地图",
)

# Words of direction, strong ones and patterns of weak ones.
BULLISH = ("看涨", "上涨", "偏强", "反弹", "走强", "做多", "多头", "上行", "回升", "冲高", "走高", "利好", "看多", "牛市", "增持", "偏多", "上移", "上探", "强势")
BEARISH = ("看跌", "下跌", "偏弱", "回落", "走弱", "做空", "空头", "下行", "下滑", "走低", "利空", "看空", "熊市", "减持", "偏空", "下移", "下探", "弱势")
NEUTRAL = ("震荡", "区间", "观望", "盘整", "横盘", "整理", "波动", "持稳", "平稳", "震荡整理", "窄幅")
BULLISH_WEAK = ("预计.*上涨", "短期.*偏强", "后市.*看涨", "有望.*上行", "预期.*偏多", "或.*反弹")
BEARISH_WEAK = ("预计.*下跌", "短期.*偏弱", "后市.*看跌", "面临.*压力", "预期.*偏空", "或.*回落")
NEUTRAL_WEAK = ("以.*震荡.*为主", "短期.*整理", "区间.*运行", "维持.*震荡", "方向.*不.*明", "等待.*选择.*方向")

# Signal patterns with their kinds, and what each kind weighs.
SIGNAL_WEIGHTS = {"direction_word": 1.00, "price_change": 0.90, "percentage": 0.90, "supply_demand": 0.75, "technical": 0.70, "momentum": 0.65, "sentiment": 0.45, "position": 0.55, "neutral": 0.50}
SIGNALS = (
    ("direction_word", "看涨", "看涨|看多|做多|利多|偏多|上行|走强|上涨|上升|反弹|回升|冲高|走高|强势"),
    ("direction_word", "看跌", "看跌|看空|做空|利空|偏空|下行|走弱|下跌|下降|回落|下滑|走低|弱势"),
    ("price_change", "看涨", r"(?:上涨|涨|上升|增加|提升|扩大)\s*(?:约|幅度)?\s*[+-]?\d+(?:\.\d+)?\s*(?:%|％|元|点|个基点)?"),
    ("price_change", "看跌", r"(?:下跌|跌|下降|减少|回落|降低|收窄)\s*(?:约|幅度)?\s*[+-]?\d+(?:\.\d+)?\s*(?:%|％|元|点|个基点)?"),
    ("supply_demand", "看涨", "(?:库存|仓单)(?:下降|减少|回落|去库)|(?:需求|消费)(?:改善|回暖|增加|旺盛)|供应(?:收紧|减少|偏紧)"),
    ("supply_demand", "看跌", "(?:库存|仓单)(?:上升|增加|累积)|(?:需求|消费)(?:走弱|下降|疲软|不佳)|供应(?:增加|宽松|过剩)"),
    ("technical", "看涨", "突破|上破|金叉|创(?:近期|阶段)?新高|底部反弹"),
    ("technical", "看跌", "破位|下破|死叉|创(?:近期|阶段)?新低|高位回落"),
    ("momentum", "看涨", r"连续\d*日上涨|涨势延续|反弹延续|上涨动能"),
    ("momentum", "看跌", r"连续\d*日下跌|跌势延续|下跌动能"),
    ("sentiment", "看涨", "市场情绪(?:偏多|乐观)|持仓(?:增加|上升)|成交活跃"),
    ("sentiment", "看跌", "市场情绪(?:偏空|悲观)|持仓(?:减少|下降)|成交低迷"),
    ("neutral", "中性", "震荡|区间运行|盘整|横盘|整理|观望|方向不明|窄幅波动|持稳|持平"),
)
RISK_WORDS = ("风险", "警惕", "压力", "承压", "不排除")

# Sections of cleaned texts and headings that name no product.
SECTION_TYPES = {"文档信息": "unknown", "核心正文": "core", "图文识别正文": "ocr", "表格与数据": "table", "AI图表解读": "ai"}
GENERIC_HEADINGS = ("观点", "观点及策略", "观点及操作策略", "操作策略", "基本面", "行情回顾", "后市展望", "风险提示", "宏观", "宏观金融", "金融期货", "商品期货", "黑色金属", "有色金属", "贵金属", "能源化工", "农产品")


def any_of(words) -> str:
    """One pattern for any of some words."""
    return "|".join(map(re.escape, words))


@dataclass(frozen=True)
class CleaningPack:
    """What the cleaning operators look for; `letters` is the class of characters that carry a text."""

    noise_patterns: tuple[str, ...] = NOISE_PATTERNS
    noise_words: tuple[str, ...] = NOISE_WORDS
    paragraphs: tuple[str, ...] = NOISE_PARAGRAPHS
    letters: str = "[一-鿿]"
    hints: tuple[str, ...] = HINTS
    core_hints: tuple[str, ...] = CORE_HINTS
    judgement_hints: tuple[str, ...] = JUDGEMENT_HINTS
    navigation: tuple[str, ...] = NAVIGATION
    starts: tuple[str, ...] = DISCLAIMER_STARTS
    more: tuple[str, ...] = DISCLAIMER_MORE
    residual: tuple[str, ...] = RESIDUAL_DISCLAIMERS
    priority: str = "观点|逻辑|建议|策略"


@dataclass(frozen=True)
class DirectionPack:
    """Strong words and weak patterns by direction."""

    up: tuple[str, ...] = BULLISH
    down: tuple[str, ...] = BEARISH
    flat: tuple[str, ...] = NEUTRAL
    up_weak: tuple[str, ...] = BULLISH_WEAK
    down_weak: tuple[str, ...] = BEARISH_WEAK
    flat_weak: tuple[str, ...] = NEUTRAL_WEAK


ZH = CleaningPack()
ZH_DIRECTIONS = DirectionPack()
#: For the driver's documents: the same rules with words that these texts hold.
DRIVER = replace(
    ZH,
    noise_words=(*NOISE_WORDS, "licensed under", "cookie", "general public license"),
    paragraphs=(*NOISE_PARAGRAPHS, "licensed under", "subscribe", "redistribution"),
    letters="[À-ɏ]",
    hints=(*HINTS, "with", "mit", "avec"),
    core_hints=(*CORE_HINTS, "from", "von"),
    judgement_hints=(*JUDGEMENT_HINTS, "this", "der"),
    navigation=(*NAVIGATION, "Home", "Menu"),
    starts=(*DISCLAIMER_STARTS, "theof", "Licensed"),
    more=(*DISCLAIMER_MORE, "and", "und"),
    residual=(*RESIDUAL_DISCLAIMERS, "warranty"),
    priority=ZH.priority + "|The|Der|El",
)
DRIVER_DIRECTIONS = DirectionPack(up=("with", "from", "mit"), down=("this", "that", "nicht"), flat=("is ", "ist ", "es "), up_weak=("for.*the", "in.*der"), down_weak=("not.*on",), flat_weak=("it.*be",))
