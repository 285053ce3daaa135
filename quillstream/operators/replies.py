"""Requests to a model and its replies, as tables: messages out, validated items and typed errors in. The call itself is an outside service."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.columns import let, stripped
from quillstream.functions.phrases import has_contacts
from quillstream.operators.cleaning import displayed
from quillstream.operators.tables import sliced
from quillstream.sources.bindings import DIRECTIONS, NEUTRAL, UNKNOWN_PRODUCT

ITEMS, CHARS, REPLY_CHARS = 6, 1200, 2000
TASK = "只根据给出的证据判断该品种的方向，返回一个 JSON 对象：product_key、direction（看涨、看跌或中性）、reason、confidence（0 到 1）、evidence_ids（1 到 3 个给定编号）。"
# Phrases that no refined text or reason may hold, and what a reply may be wrapped in.
BANNED = ("注：", "注:", "原文可能有误", "建议核实", "数据缺失", "逻辑存疑", "自我修正", "更正：", "更正:", "原文数据", "依据指令", "不改变原文含义", "作为模型", "我是AI", "我是 AI", "我无法", "以下是", "润色如下")
BANNED_REASON = ("注：", "注:", "原文可能有误", "建议核实", "数据缺失", "逻辑存疑", "自我修正", "更正：", "更正:", "作为模型", "我是AI", "我是 AI", "我无法", "以下是")
WRAPPERS = ("润色后的正文", "精修后的正文", "正文")


def requests(cases: DataFrame, most: int = ITEMS, chars: int = CHARS) -> DataFrame:
    """cases (title, product, bullish, bearish, neutral, margin, evidence: array of id and quote) with messages: a system and a user turn as JSON; at most `most` pieces of evidence, `chars` characters of them."""
    own = F.slice("evidence", 1, most)
    context = F.left(F.array_join(F.transform(own, lambda e: F.concat(F.lit("- ["), e["id"], F.lit("] "), e["quote"])), "\n"), F.lit(chars))
    summary = F.to_json(F.struct("product", F.struct("bullish", "bearish", "neutral").alias("rule_scores"), F.col("margin").alias("rule_margin"), own.alias("evidence")))
    content = F.concat(F.lit("标题："), "title", F.lit("\n待判断品种："), "product", F.lit("\n规则摘要："), summary, F.lit("\n相关原文证据：\n"), context)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return cases.withColumn("messages", F.array(message("system", F.lit(TASK)), message("user", content)))


def corrections(asked: DataFrame) -> DataFrame:
    """Requests (messages, raw, product_key, errors: array, evidence_ids: array) with two more turns: the reply as it came, capped, and what is wrong with it."""
    schema = F.to_json(F.struct("product_key", F.lit("看涨|看跌|中性").alias("direction"), F.lit("非空字符串").alias("reason"), F.lit(0.0).alias("confidence"), F.slice("evidence_ids", 1, 3).alias("evidence_ids")))
    text = F.concat(F.lit("上一次返回未通过校验："), F.array_join("errors", "；"), F.lit("。\nevidence_ids 只能从 "), F.array_join("evidence_ids", ", "), F.lit(" 中选择1到3个。\n只返回：\n"), schema)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return asked.withColumn("messages", F.concat("messages", F.array(turn("assistant", F.left("raw", F.lit(REPLY_CHARS))), turn("user", text))))


def _payload(raw: Column, fence: str = r"(?is)```(?:json)?\s*(\{.*\})\s*```") -> Column:
    """The JSON text of a reply: within a fence, else from the first brace to the last."""
    fenced = F.regexp_extract(raw, fence, 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(raw, r"(?s)\{.*\}", 0))


def _items(rows: DataFrame) -> DataFrame:
    """rows (json) with kind, and a row for each item (x, a variant; place): those of `results`, else the object itself."""
    parsed = rows.withColumn("_v", F.expr("try_parse_json(json)"))
    kind = F.expr("schema_of_variant(_v)")
    listed = F.expr("try_variant_get(_v, '$.results', 'array<variant>')")
    items = F.when(kind.startswith("OBJECT"), F.coalesce(listed, F.array("_v")))
    return parsed.withColumn("kind", kind).select(*rows.columns, "kind", F.posexplode_outer(items).alias("place", "x"))


def _text(path: str) -> Column:
    return F.trim(F.coalesce(F.expr(f"try_variant_get(x, '$.{path}', 'string')"), F.lit("")))


def strict_items(replies: DataFrame, catalog: DataFrame) -> DataFrame:
    """A row for each item of a reply (id, raw, expected_key, evidence_ids): place, product_key, direction, reason, confidence, ids, and error (null: valid) of the first rule that it breaks.

    `catalog` has name and product_key of every name that a product goes by, its key among them."""
    rows = _items(replies.withColumn("json", _payload(F.trim("raw"))))
    named = F.coalesce(F.nullif(_text("product"), F.lit("")), _text("product_key"))
    key = F.upper(_text("product_key"))
    object_ = F.expr("schema_of_variant(x)").startswith("OBJECT")
    confidence = F.expr("try_variant_get(x, '$.confidence', 'double')")
    number = F.coalesce(~F.expr("schema_of_variant(try_variant_get(x, '$.confidence', 'variant'))").isin("BOOLEAN") & confidence.between(0, 1), F.lit(False))
    ids = F.transform(F.expr("try_variant_get(x, '$.evidence_ids', 'array<string>')"), F.trim)
    rows = rows.withColumns({"_name": F.when(key != "", key).otherwise(named), "_object": object_, "direction": _text("direction"), "reason": _text("reason"), "confidence": F.when(number, confidence), "ids": ids})
    names = catalog.select(F.col("name").alias("_name"), "product_key").groupBy("_name").agg(F.min("product_key").alias("product_key"))
    joined = rows.join(names, "_name", "left")
    sound = F.coalesce((F.size("ids").between(1, 3)) & (F.size(F.array_distinct("ids")) == F.size("ids")) & ~F.array_contains("ids", "") & (F.size(F.array_except("ids", "evidence_ids")) == 0), F.lit(False))
    error = (
        F.when(F.col("kind").isNull() | ~F.col("kind").startswith("OBJECT") | ~F.coalesce("_object", F.lit(False)), "invalid_json")
        .when(F.col("product_key").isNull() | (F.col("product_key") != F.col("expected_key")), "product_mismatch")
        .when(~F.col("direction").isin(*DIRECTIONS), "invalid_direction")
        .when(F.col("reason") == "", "empty_reason")
        .when(F.col("confidence").isNull(), "invalid_confidence")
        .when(~sound, "invalid_evidence")
    )
    return joined.select("id", "place", "product_key", "direction", "reason", "confidence", F.array_join("ids", ",").alias("ids"), error.alias("error"))


def mended(json: Column) -> Column:
    """JSON without commas before closing brackets, single quotes and comments."""
    out = F.regexp_replace(F.regexp_replace(json, r",\s*([}\]])", "$1"), r"'([^']*)'(\s*:)", '"$1"$2')
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(:\s*)'([^']*)'", '$1"$2"'), r"(?m)//.*$", ""))


def lenient_items(replies: DataFrame, most: int = 240) -> DataFrame:
    """A row for each item of a reply (id, raw), as far as it can be read: place, product, contract, direction (null unless legal), reason (capped), confidence (clipped), is_primary (the surest); repeats of a product and contract are left out, a reply that cannot be read has one row with error."""
    json = _payload(F.trim("raw"), r"(?is)```(?:json)?\s*\n?(.*?)\n?```")
    rows = replies.withColumn("json", json)
    rows = rows.withColumn("json", F.when(F.expr("try_parse_json(json) IS NULL"), mended(F.col("json"))).otherwise(F.col("json")))
    items = _items(rows).withColumn("_read", F.coalesce(F.expr("schema_of_variant(x)").startswith("OBJECT"), F.lit(False)))
    direction = _text("direction")
    confidence = F.coalesce(F.expr("try_variant_get(x, '$.confidence', 'double')"), F.lit(0.0))
    out = items.select(
        "id", "place", F.nullif(_text("product"), F.lit("")).alias("product"), F.nullif(_text("contract"), F.lit("")).alias("contract"), F.when(direction.isin(*DIRECTIONS), direction).alias("direction"),
        F.left(_text("reason"), F.lit(most)).alias("reason"), F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.when(~F.col("_read"), "invalid_json").alias("error"),
    )
    again = F.row_number().over(Window.partitionBy("id", "product", F.coalesce("contract", F.lit(""))).orderBy("place"))
    once = out.withColumn("_n", again).filter("error IS NOT NULL OR product IS NULL OR _n = 1").drop("_n")
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.col("error").isNotNull(), F.desc("confidence"), "place"))
    return once.withColumn("is_primary", (first == 1) & F.col("error").isNull())


def inferred_results(items: DataFrame, articles: DataFrame, names: DataFrame, least: float = 0.5) -> DataFrame:
    """Results of a model's items (id: the article, product, contract, direction, reason, confidence): products by their catalog name, the surest of each product and contract, a neutral direction where none is given, flagged if unsure, unknown or without direction; an article without items gets one placeholder."""
    known = names.select(F.col("name").alias("product"), "product_key", "display_name").dropDuplicates(["product"])
    good = items.filter("error IS NULL").join(known, "product", "left")
    rows = good.select("id", F.coalesce("display_name", F.lit(UNKNOWN_PRODUCT)).alias("product"), F.coalesce("product_key", F.lit("")).alias("product_key"), "contract", F.lower(F.coalesce("contract", F.lit(""))).alias("_c"), "direction", "reason", "confidence", "place")
    order = Window.partitionBy("id", F.coalesce(F.nullif("product_key", F.lit("")), "product"), "_c").orderBy(F.desc("confidence"), "place")
    once = rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    flagged = (F.col("confidence") < least) | (F.col("product") == UNKNOWN_PRODUCT) | F.col("direction").isNull()
    results = once.select("id", "product", "product_key", "contract", F.coalesce("direction", F.lit(NEUTRAL)).alias("direction"), "reason", "confidence", flagged.alias("need_manual_review"))
    empty = articles.select("id").join(results.select("id").distinct(), "id", "left_anti")
    return results.unionByName(empty.select("id", F.lit(UNKNOWN_PRODUCT).alias("product"), F.lit("").alias("product_key"), F.lit(None).cast("string").alias("contract"), F.lit(NEUTRAL).alias("direction"), F.lit("").alias("reason"), F.lit(0.0).alias("confidence"), F.lit(True).alias("need_manual_review")))


def resolver_items(replies: DataFrame, catalog: DataFrame) -> DataFrame:
    """A row for each item of a resolver's reply (id, raw): block_ref, raw_name, product_key (null unless in the catalog), confidence (clipped; 0 outside it), status, and error."""
    rows = replies.withColumn("json", _payload(F.trim("raw"), r"(?is)```(?:json)?\s*(.*?)```"))
    rows = rows.withColumn("items", F.expr("try_variant_get(try_parse_json(json), '$.results', 'array<variant>')")).select("id", F.posexplode_outer("items").alias("place", "x"), F.col("items").isNull().alias("_none"))
    key = F.upper(F.coalesce(F.nullif(_text("product_key"), F.lit("")), F.lit("unknown")))
    known = catalog.select(F.col("product_key").alias("_key"), F.lit(True).alias("_known")).distinct()
    joined = rows.withColumn("_key", key).join(known, "_key", "left")
    inside = F.coalesce("_known", F.lit(False))
    confidence = F.least(F.greatest(F.coalesce(F.expr("try_variant_get(x, '$.confidence', 'double')"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    object_ = F.coalesce(F.expr("schema_of_variant(x)").startswith("OBJECT"), F.lit(False))
    error = F.when(F.col("_none"), "results are no list").when(~object_, "not an object").when(~inside & (F.col("_key") != "UNKNOWN"), "unknown product_key")
    outside = ~inside & (F.col("_key") != "UNKNOWN")
    return joined.select("id", "place", _text("block_ref").alias("block_ref"), F.left(_text("raw_name"), F.lit(255)).alias("raw_name"), F.when(inside, F.col("_key")).alias("product_key"), F.when(outside, 0.0).otherwise(confidence).alias("confidence"), F.when(outside, "unknown").otherwise(F.lower(F.coalesce(F.nullif(_text("status"), F.lit("")), F.lit("unknown")))).alias("status"), error.alias("error"))


def banned(text: Column, phrases=BANNED) -> Column:
    return reduce(lambda a, x: a | x, (F.contains(text, F.lit(p)) for p in phrases))


def refined_problem(source: Column, refined: Column) -> Column:
    """What is wrong with a refined text (null: nothing): blank, only a wrapper, a banned phrase, contacts, numbers of the source missing, much shorter, or longer than allowed."""
    numbers = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)))
    # few texts hold other blanks than spaces and line ends
    bare = lambda t: F.when(t.rlike(r"[\t\x0B\f\r]"), F.regexp_replace(t, r"\s+", "")).otherwise(F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))

    def against(text: Column, compact: Column, shown: Column) -> Column:
        return (
            F.when(shown.rlike("[0123456789]") & (F.size(F.array_except(numbers(shown), numbers(compact))) > 0), "numbers")
            .when((F.length(shown) >= 120) & (F.length(compact) < 0.45 * F.length(shown)), "short")
            .when(F.length(text) > F.floor(1.15 * F.length(source) + 200), "long")
        )

    def problem(r: Column) -> Column:
        text, compact = r["text"], r["compact"]
        alone = F.when(text == "", "blank").when(compact.isin(*WRAPPERS), "wrapper").when(banned(text), "banned").when(has_contacts(text), "contacts")
        # the source is only shown for texts that nothing else is wrong with
        return alone.otherwise(let(let(displayed(source), bare), lambda shown: against(text, compact, shown)))

    return let(stripped(F.coalesce(refined, F.lit(""))), lambda t: let(F.struct(t.alias("text"), bare(t).alias("compact")), problem))


def refined_reason(raw: Column, reason: Column, source: Column, direction: Column) -> Column:
    """A model's wording of a reason if it may be shown (up to 280 characters, no banned phrase, no contacts), else the reason or text itself, cleaned and capped."""
    text = stripped(F.coalesce(raw, F.lit("")))
    text = F.regexp_replace(text, r"(?s)^```(?:\w+)?\s*(.*?)\s*```\z", "$1")
    text = displayed(F.regexp_replace(text, r"^\s*(?:结论依据|依据|整理后|精修后)\s*[:：]\s*", ""), 260)
    own = displayed(F.coalesce(F.nullif(reason, F.lit("")), source), 260)
    fallback = F.coalesce(F.nullif(own, F.lit("")), F.concat(F.lit("规则识别: "), direction))
    good = lambda t: (t != "") & ~has_contacts(t) & (F.length(t) <= 280) & ~banned(t, BANNED_REASON)
    return let(text, lambda t: F.when(good(t), t).otherwise(fallback))


#: What begins a heading's line.
HEADED = r"^(?:#{1,6}\s+|【[^】]{1,40}】)"


def paragraphs(text: Column) -> Column:
    """Paragraphs (an array) of a text whose lines are broken by layout: lines run on until a blank one; headings stand alone."""
    return run_on(F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), stripped))


def run_on(lines: Column, headed: str = HEADED) -> Column:
    """Paragraphs (an array) of lines without blanks at their ends."""
    heading = lambda x: x.rlike(headed)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    ended = lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"]))
    step = lambda a, x: F.when(x == "", F.struct(ended(a).alias("done"), F.lit("").alias("now"))).when(heading(x), F.struct(F.array_append(ended(a), x).alias("done"), F.lit("").alias("now"))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["now"], x).alias("now")))
    return F.aggregate(lines, start, step, ended)


def chunks(docs: DataFrame, most: int = 1500, text: str = "text") -> DataFrame:
    """doc_id, place, chunk: texts in pieces of at most `most` characters, cut between paragraphs, else after a sentence, else (in the latter half) after a clause, else anywhere."""
    from collections.abc import Iterator

    import pyarrow as pa

    def pieces(block: str) -> list[str]:
        out, block, at = [], block.strip(), 0
        while len(block) - at > most:
            window = block[at : at + most]
            cut = max(window.rfind(m) for m in "。！？；")
            if cut < most // 2:
                clause = max(window.rfind(m) for m in "，、：")
                cut = clause if clause >= most // 2 else cut
            cut = cut + 1 if cut >= 0 else most
            out.append(window[:cut].strip())
            # what is left is not copied: a block may be long
            at += cut
            while at < len(block) and block[at].isspace():
                at += 1
        return [*out, block[at:]] if at < len(block) else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, places, texts = [], [], []
            for doc, blocks in zip(batch.column("doc_id").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                done, now = [], ""
                for i, block in enumerate(blocks or []):
                    # a break of two line ends counts with what follows it
                    for part in (["\n\n"] if i else []) + (pieces(block) if len(block) > most else [block]):
                        if now and len(now) + len(part) > most:
                            done.append(now.strip())
                            now = ""
                        now += part
                done = [x for x in [*done, now.strip()] if x]
                ids += [doc] * len(done)
                places += range(len(done))
                texts += done
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "place", "chunk"])

    return docs.select("doc_id", paragraphs(F.col(text)).alias("blocks")).mapInArrow(run, "doc_id long, place int, chunk string")
