"""Market texts in Chinese, as the rules were made for: one case for each."""

import pytest
from pyspark.sql import functions as F

from quillstream import packs
from quillstream.functions import columns as fn
from quillstream.functions import evidence as ev
from quillstream.functions import phrases as ph
from quillstream.operators import cleaning as cl
from quillstream.operators import discovery as di
from quillstream.operators import files as fl
from quillstream.operators import pages as pg
from quillstream.operators import replies as rp
from quillstream.operators import spans as sp
from quillstream.operators import store as st
from quillstream.operators import text


@pytest.fixture(scope="module")
def of(spark):
    """The value of a column function for a text."""
    return lambda f, *values: spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


def test_width_keeps_the_marks_of_texts(of):
    assert of(ph.half_width, "价格，上涨：ＡＢ１２％（见下）") == "价格，上涨：AB12%（见下）"
    assert of(ph.alias_key, " 【ＲＢ ２５】：") == "rb25" and of(lambda x: ph.alias_key(x, canonical=True), "“Ａ/Ｂ”，c、") == "abc"


def test_contacts_and_quotes(of):
    assert of(ph.without_contacts, "see www.abc.com now").split() == ["see", "now"]
    assert of(ph.has_contacts, "从业资格 证号：F123456") and not of(ph.has_contacts, "价格上涨")
    assert of(ph.compacted, "， 库存  下降 。 （ 见 ） ：") == "库存 下降。 （见）"
    assert of(lambda x: ph.clean_quote(x, ("WWW.X.CN",)), "[PAGE 3] 价 格 上涨 www.x.cn 3 / 12 研究所晨会观点精粹 。") == "价格上涨。"


def test_markup_and_secrets(of):
    assert of(fn.without_markup, "a&nbsp;&ldquo;b&rdquo;<br/>&#x4e00;c&hellip; 1 < 2") == 'a "b" c… 1 < 2'
    assert of(lambda x: fn.redacted(x, ("s3cr3t",), 60), "s3cr3t Bearer abc.d ?token=x&a=1 api_key: 'y z' end") == "[REDACTED] Bearer [REDACTED] ?token=[REDACTED]&a=1 api_key: [REDACTED] end"[:60]


def test_context_of_signals(of):
    flags = lambda b, a: of(lambda x, y: F.array_join(ph.context_flags(x, y), ","), b, a)
    assert flags("螺纹钢昨日", "，但今日") == "historical" and flags("价格不", "") == "negated" and flags("", "但存在风险") == "risk_context"
    assert of(lambda x: ph.context_factor(F.split(x, ",")), "negated,risk_context") == pytest.approx(0.175) and of(lambda x: ph.signal_factor(F.split(x, ",")), "historical") == 0.5


def test_noise_lines_and_paragraphs(of):
    kept = lambda t: of(lambda x: F.array_join(cl.without_noise_lines(x), "\n"), t)
    assert kept("螺纹钢上涨\n版权所有 某公司\n\n3 / 12\n第五页\nhttps://a.b/c\n库存下降") == "螺纹钢上涨\n\n库存下降"
    assert of(cl.without_noise_paragraphs, "正文\n免责声明：本报告\n  续行\n下文") == "正文\n\n下文"


def test_lines_of_images(spark):
    lines = ["观点：需求改善，价格偏强", "12 34 56 78", "2024-01 2024-02 03/04 05/06 07/08", "100 200 300 400", "期货有限公司是经中国证监会批准", "资产管理 等业务", "库存继续下降，关注装置变化", "日报", "[图片分片 3]", "abc XYZ", "数据来源：某处"]
    table = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, line string")
    reasons = {r["pos"]: r["reason"] for r in cl.semantic_lines(table, "ocr").collect()}
    assert [i for i in reasons if reasons[i] is None] == [0, 6]
    assert reasons[4] == reasons[5] == "disclaimer" and reasons[7] == "navigation" and reasons[8] == "slice" and reasons[1] == "numeric" and reasons[9] == "low_value" and reasons[10] == "strict"


def test_structured_texts(spark):
    raw = "# 铜日报\n来源文件: a/b/铜.html\n解析器: html\n\n## 正文文本\n观点：铜价上涨，需求改善，库存下降。\n版权所有\n\n## 表格数据\n| 品种 | 价格 |\n| --- | --- |\n| 铜 | 100 |\n\n## 图片OCR文本: p.png\n成本支撑仍在，关注库存\n【观点：短期偏强"
    docs = spark.createDataFrame([(1, raw)], "doc_id long, text string")
    out = cl.structured_text(cl.template_parts(text.lines(docs))).first()["cleaned"]
    assert out == "# 铜日报\n\n## 文档信息\n\n来源文件: 铜.html\n解析器: html\n\n## 核心正文\n\n观点：铜价上涨，需求改善，库存下降。\n\n## 表格与数据\n\n### 表格: 价格/库存/基差数据\n| 品种 | 价格 |\n| --- | --- |\n| 铜 | 100 |\n\n## 图文识别正文\n\n观点：短期偏强\n成本支撑仍在，关注库存"


def test_displayed_texts(of):
    raw = "```\n## Page 3\n来源文件: x\n铜价 上涨 ， 联系电话：010-12345678\n铜价上涨\n免责声明\n某某期货有限公司\n库存下降\n库存 下降\n```"
    assert of(cl.displayed, raw) == "铜价 上涨\n库存下降"
    assert of(lambda x: cl.displayed(x, 5), "库存下降，需求改善") == "库存下降。"


def test_lexicon_matches(spark):
    docs = spark.createDataFrame([(1, "RB2509合约上涨，螺纹钢库存下降"), (2, "COMEX黄金上涨"), (3, "国内黄金上涨")], "doc_id long, text string")
    found = sp.matches(docs, {"rb": "SHFE.RB", "螺纹钢": "SHFE.RB", "黄金": "SHFE.AU"}, ("COMEX",)).collect()
    assert sorted((r["doc_id"], r["product_key"]) for r in found) == [(1, "SHFE.RB"), (1, "SHFE.RB"), (3, "SHFE.AU")]


def test_signal_patterns(spark):
    docs = spark.createDataFrame([(1, "螺纹钢库存下降，需求改善，短期偏强，上涨3.5%")], "doc_id long, text string")
    kinds = {f"{k}:{d}:{i}": p for i, (k, d, p) in enumerate(packs.SIGNALS)}
    phrases = {(r["kind"].split(":")[0], r["phrase"]) for r in sp.spans(docs, kinds).collect()}
    assert {("supply_demand", "库存下降"), ("supply_demand", "需求改善"), ("price_change", "上涨3.5%")} <= phrases
    best = sp.longest_first(sp.spans(docs, kinds).select("doc_id", "start", "stop", F.split_part("kind", F.lit(":"), F.lit(2)).alias("direction"), F.lit(1.0).alias("confidence")), "doc_id")
    assert (4 - 1, 7) in {(r["start"], r["stop"]) for r in best.collect()}


def test_arbitration_counts_context(spark):
    rows = [(1, "P", "看涨", 1.0, 1.0, 0.25), (1, "P", "看跌", 1.0, 1.0, 1.0), (2, "P", "看涨", 1.0, 1.0, 1.0)]
    out = {r["article_id"]: r for r in text.arbitrated(spark.createDataFrame(rows, "article_id long, product_key string, direction string, weight double, confidence double, factor double")).collect()}
    assert out[1]["direction"] == "看跌" and out[2]["decision"] == "rule_accept"
    mentions = spark.createDataFrame([(2, "P"), (3, "Q")], "article_id long, product_key string")
    assert {r["article_id"]: r["decision"] for r in text.decided(text.arbitrated(spark.createDataFrame(rows[2:], "article_id long, product_key string, direction string, weight double, confidence double, factor double")), mentions).collect()} == {2: "rule_accept", 3: "no_signal"}


def test_aliases_are_found(spark):
    aliases = {"螺纹钢": "SHFE.RB", "黄金": "SHFE.AU", "铁矿石": "DCE.I", "碳酸锂": "GFEX.LC", "豆油": "DCE.Y", "硅锰": "CZCE.SM", "硅铁": "CZCE.SF"}
    texts = ["RB2505合约上涨，PTA05 合约下跌", "【铁矿石】价格震荡", "商品：碳酸锂 库存下降", "COMEX黄金上涨", "mail a@b.cn 黄金", "【硅锰/硅铁】现货持平", "【a/b 12/30】"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = di.occurrences(docs, aliases, {"RB": "SHFE.RB", "TA": "CZCE.TA", "PTA": "CZCE.TA"}).collect()
    good = {(r["doc_id"], r["kind"], r["product_key"]) for r in rows if r["negative"] is None}
    assert {(0, "contract_code", "SHFE.RB"), (0, "contract_code", "CZCE.TA"), (1, "bracket_heading", "DCE.I"), (2, "label_field", "GFEX.LC"), (5, "bracket_heading", "CZCE.SM"), (5, "bracket_heading", "CZCE.SF")} <= good
    assert {r["negative"] for r in rows if r["doc_id"] in (3, 4) and r["kind"] == "catalog_alias"} == {"foreign_market_context"}
    assert {r["negative"] for r in rows if r["doc_id"] == 6 and r["kind"] == "bracket_heading"} == {"numeric_coordinate_or_range"}


def test_evidence_in_three_shapes(of):
    quotes = lambda e: of(lambda x: F.array_join(ev.evidence_quotes("c0"), "|"), e)
    assert quotes('"库存 下降"') == "库存 下降" and quotes('["a b", {"text": "c d"}, 3]') == "a b|c d|3" or quotes('["a b", {"text": "c d"}]') == "a b|c d"
    assert quotes('{"excerpts": [{"quote": "e f"}], "quote": "no"}') == "e f" and quotes('{"raw": "g h"}') == "g h" and quotes('"no_signal"') == "" and quotes("not json") == ""
    assert of(ev.without_dangling_tail, "库存下降。需求改善。价格较") == "库存下降。需求改善。" and of(ev.without_dangling_tail, "没有句号") == "没有句号"


def test_replies_with_faults(spark):
    raws = ["{\"product\": \"铜\", \"direction\": \"看涨\", \"reason\": \"r\", \"confidence\": 0.8,}", "说明 {'product': '铜', 'direction': 'up', 'confidence': 7}", "garbage", '```json\n{"results": [{"product": "铜", "confidence": 0.3}, {"product": "铜", "confidence": 0.9}, {"product": "铝", "confidence": 0.6}]}\n```']
    rows = rp.lenient_items(spark.createDataFrame(list(enumerate(raws)), "id long, raw string")).collect()
    by = {(r["id"], r["product"]): r for r in rows}
    assert by[0, "铜"]["direction"] == "看涨" and by[0, "铜"]["is_primary"] and by[1, "铜"]["direction"] is None and by[1, "铜"]["confidence"] == 1.0
    assert by[2, None]["error"] == "invalid_json" and len([r for r in rows if r["id"] == 3]) == 2 and by[3, "铝"]["is_primary"]


def test_refined_texts(of):
    source = "铜价上涨3.5%，库存下降。" * 12
    problem = lambda t: of(rp.refined_problem, source, t)
    assert problem(source) is None and problem("") == "blank" and problem("正文") == "wrapper" and problem(source + "以下是") == "banned"
    assert problem(source.replace("3.5", "")) == "numbers" and problem("上涨3.5%。") == "short" and problem(source * 3) == "long" and problem(source + " a@b.cn") == "contacts"


def test_paragraphs_and_chunks(spark, of):
    assert of(lambda x: F.array_join(rp.paragraphs(x), "|"), "# 标题\n铜价\n上涨\n\n【铝】走势\n铝价") == "# 标题|铜价上涨|【铝】走势|铝价"
    long = "第一句很长。" * 10 + "尾" * 30
    rows = rp.chunks(spark.createDataFrame([(1, long + "\n\n短段"), (2, None)], "doc_id long, text string"), 40).orderBy("place").collect()
    assert all(len(r["chunk"]) <= 40 for r in rows) and "".join(r["chunk"] for r in rows).replace("\n", "") == long + "短段" and {r["doc_id"] for r in rows} == {1}


def test_files_in_other_encodings(spark):
    rows = [("a", "# 标题\n铜价".encode("gb18030")), ("b", "﻿x".encode()), ("c", "銅價".encode("big5")), ("d", b"\xff\xfe\xff"), ("e", None)]
    got = {r["path"]: r for r in fl.decoded(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a"]["text"] == "# 标题\n铜价" and got["a"]["title"] == "标题" and got["b"]["text"] == "x" and got["e"]["text"] == "" and "�" in got["d"]["text"]


def test_main_content_and_tables(spark):
    html = "<html><head><title>站</title></head><body><div class='nav'><a>首页</a><a>关于我们</a></div><div class='article'><h1>铜日报</h1><p>" + "铜价上涨，库存下降。" * 8 + "</p><table><tr><th colspan='2'>品种</th></tr><tr><td>铜</td><td>1</td></tr></table></div><div style='display:none'>" + "隐藏" * 300 + "</div></body></html>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = {r["page_id"]: r for r in pg.page_content(pages).collect()}
    assert got[1]["title"] == "铜日报" and "铜价上涨" in got[1]["content"] and "首页" not in got[1]["content"] and "隐藏" not in got[1]["content"] and got[2]["content"] == ""
    table = pg.rendered(pg.table_rows(pages)).first()
    assert table["markdown"] == "| 品种 |   |\n| --- | --- |\n| 铜 | 1 |" and table["plain"] == "表头: 品种 | \n第1行: 铜 | 1"


def test_names_in_order_of_the_dictionary(spark):
    rows = spark.createDataFrame([(x,) for x in ("铜", "白糖", "玻璃", "铝")], "product string")
    assert [r["product"] for r in st.by_name(rows).collect()] == ["白糖", "玻璃", "铝", "铜"]


def test_windows_go_by_position(spark):
    from quillstream.operators import curation as cu

    rows = spark.createDataFrame([(1, p, p == 10) for p in (1, 5, 8, 10, 12, 13)], "doc long, pos long, hit boolean")
    assert sorted(r["pos"] for r in cu.hit_window(rows, F.col("hit"), 2, "doc").collect()) == [8, 10, 12]


def test_compatibility_forms_of_all_code_points(spark):
    import re
    import unicodedata

    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(points[i : i + 40]) for i in range(0, len(points), 40)] + [f" {c}1) " for c in "ßﬁ①ｱﾞ㎏ǅΣİ　½Å"] + ["", " ", "（沪） 铜：", "ABC\x1cd"]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    rows = docs.select("t", ph.nfkc("t").alias("n"), ph.alias_key("t").alias("k"), ph.alias_key("t", True).alias("c"), ph.shown_alias("t").alias("s")).collect()
    key = re.compile(r"[\s【】\[\]():]+")
    wide = re.compile("[\\s\u200b-\u200d\ufeff【】\\[\\](){}<>:、,;/\\\\\"'“”‘’`]+")
    for r in rows:
        if r["t"] is None:
            assert r["n"] is r["k"] is r["s"] is None
            continue
        n = unicodedata.normalize("NFKC", r["t"])
        assert (r["n"], r["k"], r["c"], r["s"]) == (n, key.sub("", n.strip().casefold()), wide.sub("", n.strip().casefold()), n.strip().strip("【】[](){}<>:、,;")), r["t"][:3]


def test_blanks_of_chinese_texts(spark):
    docs = spark.createDataFrame([("　　第3页　",), ("　　价格 上涨　\n　免责声明：略\n　　续行\n正文",)], "t string")
    first, second = docs.select(cl.noise_line(F.col("t")).alias("n"), cl.without_noise_paragraphs(F.col("t")).alias("p"), fn.normalized_space("t").alias("x")).collect()
    assert first["n"] and second["p"] == "　　价格 上涨　\n　\n正文" and second["x"] == "　　价格 上涨\n免责声明：略\n续行\n正文"
