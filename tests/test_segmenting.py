"""Segments of market texts: one case for each rule, in Chinese as the texts are."""

import pytest

from quillstream.operators import segmenting as sg

NAMES = sg.Names(
    {"乙二醇": "DCE.EG", "EG": "DCE.EG", "股指": "GROUP.CFFEX.INDEX", "PVC": "DCE.V", "PTA": "CZCE.TA", "沪铝": "SHFE.AL", "铝": "SHFE.AL", "沪锡": "SHFE.SN", "锡": "SHFE.SN", "沪铜": "SHFE.CU", "铜": "SHFE.CU", "聚乙烯": "DCE.L", "原油": "INE.SC", "钢材": "GROUP.SHFE.STEEL"},
    {"V": "DCE.V", "EG": "DCE.EG", "TA": "CZCE.TA", "AL": "SHFE.AL", "CU": "SHFE.CU"},
)

CASES = {
    "one product": ("# 铜日报\n\n## 文档信息\n\n来源文件: sample.html\n\n## 核心正文\n\n铜：关税不确定性铜承压震荡。\n库存下降但需求受抑，短线谨慎参与。", [("SHFE.CU", "core")]),
    "prefixes": ("## 核心正文\n\n乙二醇：供应压力仍高，价格承压，短期偏弱。\n股指：海外扰动增加，风险偏好回落，维持震荡。", [("DCE.EG", "core"), ("GROUP.CFFEX.INDEX", "core")]),
    "contracts": ("## 核心正文\n\nPVC05合约下跌39元，库存加速去化。\nEG05合约下跌4元，乙二醇港口库存累库，预期震荡偏弱。", [("DCE.V", "core"), ("DCE.EG", "core")]),
    "contract with a blank": ("## 核心正文\n\nPTA05 合约下跌52元，供给端仍处于检修季，加工费承压。", [("CZCE.TA", "core")]),
    "brackets": ("## 图文识别正文\n\n【乙二醇】港口库存回升，供应压力偏高。【股指】市场波动加剧，观望为主。", [("DCE.EG", "ocr"), ("GROUP.CFFEX.INDEX", "ocr")]),
    "several lines": ("## 核心正文\n\n【铝】铝锭小幅去库，短期偏空。\n【锡】传原定于4月1日召开的矿山复工复产交流会被取消，夜盘锡价上涨。\n缅甸强震带来扰动，锡矿供应偏紧。", [("SHFE.AL", "core"), ("SHFE.SN", "core")]),
    "a group": ("## 核心正文\n\n【钢材】国内钢材期现货市场延续弱势。\n有色铜价也承压，但本段观点仍是钢材。", [("GROUP.SHFE.STEEL", "core")]),
    "sentences": ("## 核心正文\n\n乙二醇供应压力仍高。价格短期偏弱。股指受风险偏好影响。整体维持震荡。", [("DCE.EG", "core"), ("GROUP.CFFEX.INDEX", "core")]),
    "a leader": ("## 图文识别正文\n\n观点: 聚乙烯震荡下行阶段，后期价格中枢有望下降。\n逻辑: 聚乙烯产能压力巨大，基差回落，成本端原油预期也偏弱。", [("DCE.L", "ocr")]),
    "mixed": ("## 核心正文\n\n乙二醇和股指均受宏观扰动影响，方向仍需等待进一步确认。", [("DCE.EG", "mixed"), ("GROUP.CFFEX.INDEX", "mixed")]),
    "none": ("## 核心正文\n\n研究报告仅包含宏观摘要，暂无明确品种。", [("", "core")]),
    "an unknown heading": ("## 核心正文\n\n【欧集线】运价预期偏强，供给扰动增加。\n【沪铜】库存上升，需求承压。", [("", "core"), ("SHFE.CU", "core")]),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES.values())], "doc_id long, text string")
    rows = sg.segments(sg.blocks(sg.sections(docs), NAMES), NAMES).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["segment_index"])):
        out.setdefault(list(CASES)[r["doc_id"]], []).append(r)
    return out


@pytest.mark.parametrize("name", CASES)
def test_products_and_sections(found, name):
    rows = [r for r in found[name] if r["section_type"] != "unknown"]
    assert [(r["product_key"], r["section_type"]) for r in rows] == CASES[name][1]


@pytest.mark.parametrize("name", CASES)
def test_offsets_give_the_text(found, name):
    for r in found[name]:
        assert CASES[name][0][r["start"] : r["stop"]] == r["text"]


def test_contracts_and_confidence(found):
    pvc, eg = found["contracts"]
    assert (pvc["contract"], eg["contract"]) == ("05", "EG05") and "EG05" not in pvc["text"] and "PVC05" not in eg["text"]
    assert found["contract with a blank"][0]["contract"] == "05"
    assert [r["confidence"] for r in found["brackets"]] == [0.96, 0.96] and found["mixed"][0]["confidence"] == 0.35 and found["none"][0]["confidence"] == 0.1
    assert {r["confidence"] for r in found["sentences"]} == {0.72} and "价格短期偏弱" in found["sentences"][0]["text"]
    assert found["a leader"][0]["confidence"] == 0.82 and "原油" in found["a leader"][0]["text"]
    assert found["an unknown heading"][0]["heading"] == "欧集线"


def test_directions_and_confidence_of_rules(spark):
    texts = ["螺纹钢价格看涨，短期偏强运行，预计后市继续上涨。", "螺纹钢短期看涨，但长期看跌。", "螺纹钢看涨上涨偏强反弹", "以窄幅震荡整理为主", "没有方向", "预计有上涨"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sg.directions(docs).collect()}
    assert rows[0]["direction"] == "看涨" and rows[0]["up"] >= 3 and not rows[0]["conflict"]
    assert rows[1]["conflict"] and rows[1]["need_llm"]
    assert rows[2]["confidence"] >= 0.7 and not rows[2]["need_llm"]
    assert rows[3]["direction"] == "中性" and rows[3]["confidence"] <= 0.6
    assert rows[4]["direction"] is None and rows[4]["confidence"] == 0


def test_reasons_stand_around_the_words(spark):
    text = "第一句。第二句。第三句。价格上涨。第五句。第六句。第七句。"
    docs = spark.createDataFrame([(1, text, "看涨"), (2, "无关", "看跌"), (3, "无关", None)], "doc_id long, text string, direction string")
    rows = {r["doc_id"]: r["reason"] for r in sg.reasons(docs).collect()}
    assert rows == {1: "第二句。第三句。价格上涨。第五句。第六句。", 2: "无关", 3: ""}


def test_manual_keys_by_fingerprint(spark, found):
    docs = spark.createDataFrame([(0, CASES["an unknown heading"][0])], "doc_id long, text string")
    parts = sg.segments(sg.blocks(sg.sections(docs), NAMES), NAMES)
    none = spark.createDataFrame([], "fingerprint string, manual_key string")
    unknown = sg.unknown_blocks(sg.overridden(parts, none)).collect()
    assert [u["raw_name"] for u in unknown] == ["欧集线"]
    manual = spark.createDataFrame([(unknown[0]["fingerprint"], "INE.EC")], "fingerprint string, manual_key string")
    rows = sorted(sg.overridden(parts, manual).collect(), key=lambda r: r["segment_index"])
    assert [(r["product_key"], r["way"], r["confidence"]) for r in rows] == [("INE.EC", "manual", 1.0), ("SHFE.CU", "heading", 0.96)]


def test_sections_and_blocks_as_by_loops(spark, sf_dir):
    """Texts are cut once, in their task: joined to each of their borders, they grew with a text's length squared."""
    import random
    import re

    import __spark_entry__

    plan = __spark_entry__.queries()["g2_blocks"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    names = sg.Names({"rb": "K1", "螺纹": "K2", "the": "K3"}, {"cu": "K4"})
    rnd, signs = random.Random(3), ["【", "】", "【rb】", "\n", " ", "\t", "。", ";", "rb05合约", "cu 25 合约", "RB05 合约", "the", "the：", "螺纹", "螺纹 ", "#", "## a ", "\n##\n## b", "\n## 核心正文\n", "x" * 9, "\u3000", "\U0001f600", "é", "合约"]
    texts = {i: "".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for i in range(400)} | {1000: "", 1001: "\n".join(["rb：a【b】"] * 500)}
    blank = " \n" + "\t\x0b\f\r\u3000"
    want = set()
    starts = ["【[^】]{1,20}】", rf"(?a)(?:(?<=[\n。！？；;])|\A)\s*(?={names.contract[4:]})", rf"(?a)(?<=\n)[ \t]*(?=\S)(?=#|【|{names.prefix[4:]})".replace(r"\z", r"\Z")]
    for i, text in texts.items():
        heads = [m.span() for m in re.finditer(r"(?am)^##\s+[^\n]+?[ \t]*$", text)]
        parts = [(text[a:b], b, e) for (a, b), e in zip(heads, [h[0] for h in heads[1:]] + [len(text)], strict=True)] if heads else [("", 0, len(text))]
        number = 0
        for _, a, b in parts:
            own = text[a:b].strip(blank)
            if not own:
                continue
            number, base = number + 1, a + len(text[a:b]) - len(text[a:b].lstrip(blank))
            at = {0, *(m.start() for m in re.finditer(starts[0], own)), *(m.end() for m in re.finditer(starts[1], own, re.I | re.A)), *(m.end() for m in re.finditer(starts[2], own))}
            at = sorted(x for x in at if x < len(own))
            for x, y in zip(at, [*at[1:], len(own)], strict=True):
                cut = own[x:y].strip(blank)
                if cut:
                    low = base + x + len(own[x:y]) - len(own[x:y].lstrip(blank))
                    want.add((i, number, low, low + len(cut), cut))
    docs = spark.createDataFrame([*texts.items(), (2000, None)], "doc_id long, text string").repartition(4)
    got = sg.blocks(sg.sections(docs), names).select("doc_id", "section", "start", "stop", "text").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_directions_and_reasons_as_by_loops(spark, sf_dir):
    """Words in order on a line are looked for once in it, and a sentence is near by its neighbours' flags: patterns and lists of hits grew with a text's length squared."""
    import random
    import re

    import __spark_entry__
    from pyspark.sql import functions as F

    from quillstream.operators import text as tx
    from quillstream.packs import DRIVER_DIRECTIONS, ZH_DIRECTIONS

    plan = __spark_entry__.queries()["g7_reasons"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "exists(" not in plan
    rnd = random.Random(11)
    signs = ["for", "the", "in", "der", "with ", "mit", "is ", "it", "be", "not", "on", " ", "\n", "\r", "\x85", "\u2028", "。", "！", "？", "；", "预计", "上涨", "等待", "选择", "方向", "不", "明", "震荡", "以", "为主", "é", "\U0001f600", "aa"]
    texts = {i: "".join(rnd.choice(signs) for _ in range(rnd.randrange(50))) for i in range(400)} | {1000: "", 1001: "in the under " * 3000, 1002: "with。" * 2000}
    docs = spark.createDataFrame([*texts.items(), (2000, None)], "doc_id long, text string")
    blank = " \n\t\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u2028\u3000"
    for pack in (DRIVER_DIRECTIONS, ZH_DIRECTIONS):
        for r in sg.reasons(tx.directions(docs, pack, ("up", "down", "flat")), pack, ("up", "down", "flat")).collect():
            if r["doc_id"] == 2000:
                continue
            text = r["text"]
            weak = lambda p: sum(len(re.findall(p, x)) for x in re.split("[\n\r\x85\u2028\u2029]", text))  # noqa: E731, B023
            sides = {"up": (pack.up, pack.up_weak), "down": (pack.down, pack.down_weak), "flat": (pack.flat, pack.flat_weak)}
            counts = {n: [text.count(w) for w in s] + [weak(p) for p in v] for n, (s, v) in sides.items()}
            assert {n: r[n] for n in sides} == {n: sum(c) for n, c in counts.items()}
            assert r["strong"] == sum(w in text for s, _ in sides.values() for w in s) and r["weak"] == sum(weak(p) > 0 for _, v in sides.values() for p in v)
            top = max(r[n] for n in sides)
            direction = next(n for n in sides if r[n] == top) if top else None
            pieces = [x for x in (y.strip(blank) for y in re.findall(r"[^。！？；\n]*[。！？；\n]|[^。！？；\n]+", text)) if x]
            hits = {i for i, x in enumerate(pieces) if direction and any(w in x for w in sides[direction][0])}
            near = "".join(x for i, x in enumerate(pieces) if any(i + k in hits for k in range(-2, 3)))
            compact = re.sub(r"(?a)\s+", " ", text).strip(" ")[:220]
            assert (r["direction"], r["reason"]) == (direction, "" if direction is None else near or compact)
    odd = spark.createDataFrame([("a1b a2b",)], "text string")
    assert odd.select(tx._weak(F.col("text"), F.split("text", "\n"), r"a\d.*?b").alias("n")).first().n == 2
