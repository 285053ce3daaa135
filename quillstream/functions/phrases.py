"""Column functions over phrases and texts: alias keys, residue, quotes, contracts, sentences, context flags."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.columns import col, let, stripped

#: Full-width letters, digits and signs by their code points, and what they stand for.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
# Full-width marks that stay as they are in texts.
MARKS = "，．！？；：［］（）～"
TEXT_WIDE = "".join(c for c in WIDE if c not in MARKS)
TEXT_NARROW = "".join(n for w, n in zip(WIDE, NARROW, strict=True) if w not in MARKS)

# Patterns of contacts and credentials, labels of review reasons, words of market texts.
CONTACTS = (
    r"(?:基本\s*)?(?:投资咨询|从业资格|执业资格|期货从业|证券从业)\s*证号\s*[:：]?\s*[A-Z]?\d{5,}",
    r"(?:E[-\s]?MAIL|Email|email|邮箱|电子邮箱)\s*[:：]?\s*[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    r"(?:联系电话|咨询电话|客服电话|客服热线|电话|传真|手机)\s*[:：]?\s*(?:\+?86[-\s]?)?(?:\d{3,4}[-\s]?\d{6,8}|\d{3}[-\s]?\d{3}[-\s]?\d{4}|\d{7,12})",
    r"(?:网址|网站)\s*[:：]?\s*(?:https?://)?(?:www\.)?[A-Za-z0-9.\-/]+",
    r"https?://\S+",
    r"\bwww\.[A-Za-z0-9.\-/]+",
)
#: What a text holds at least where one of these patterns fits, in their order.
SIGNS = ("证号", "@", "@", "电话|热线|传真|手机", "网址|网站", "://", "[wW]{3}")
RESIDUES = ("从业资格证号", "投资咨询证号", "免责申明", "免责声明")
QUOTE_NOISE = ("请务必仔细阅读正文后免责申明", "研究所晨会观点精粹")
CLOSING, OPENING, BRACKETS = "，。；：！？、", "【（(", "】）)"
ENDS = r" \t:：,，;；"
REASONS = {
    "no_signal": "识别到品种，但未找到有效方向信号",
    "no_product_match": "未识别到有效期货品种",
    "related_product_mention_only": "仅在其他品种分析中被提及，不构成独立方向结论",
    "rule_evidence_quality_failed": "规则结论缺少可验证证据",
    "llm_evidence_quality_failed": "大模型结论缺少可验证证据",
    "llm_error_or_invalid_output": "大模型分析失败或返回格式无效",
}
HINTS = (
    "观点", "逻辑", "建议", "操作", "策略", "展望", "预测", "预计", "预期", "价格", "上涨", "下跌", "上行", "下行", "偏强", "偏弱", "震荡",
    "库存", "需求", "供应", "成本", "利润", "基差", "现货", "期货", "利多", "利空", "支撑", "压力", "风险", "关注",
)
RISKS = (30, ("风险", "警惕", "压力", "承压", "不排除"))
RISK_FACTOR, SIGNAL_FACTORS = 0.70, {"negated": 0.35, "conditional": 0.70, "historical": 0.50, "risk_context": 0.75, "after_turn": 0.75}
CONTEXT = {
    "negated": (8, 0.25, ("不", "未", "没有", "并非", "难以", "尚未", "未见")),
    "conditional": (15, 0.65, ("若", "如果", "一旦", "除非", "在……情况下", "假设")),
    "historical": (15, 0.45, ("昨日", "此前", "过去", "前期", "上周", "此前一度")),
    "after_turn": (12, 0.75, ("但", "然而", "不过", "转为", "随后")),
}
CJK = r"[一-鿿]"


def half_width(text: Column | str) -> Column:
    """Letters, digits and signs in half width; the marks of Chinese texts stay."""
    return F.translate(col(text), TEXT_WIDE, TEXT_NARROW)


#: Texts that compatibility normalisation leaves alone but for case: they stay in the JVM.
_PLAIN = r"^[\x00-\x1B\x20-\x7F一-鿿]*\z"


def _unicode(text: Column | str, native: Column, change: Callable[[str], str]) -> Column:
    """native where a text is plain, else change(text), by Arrow batch; plain texts go to it as nulls."""
    plain = col(text).rlike(_PLAIN)

    @F.pandas_udf("string")
    def changed(texts: pd.Series) -> pd.Series:
        return texts.map(change, na_action="ignore")

    return F.when(plain, native).otherwise(changed(F.when(~plain, col(text))))


def nfkc(text: Column | str) -> Column:
    """Unicode's compatibility form."""
    return _unicode(text, col(text), lambda t: unicodedata.normalize("NFKC", t))


#: What an alias is spelled without: in the legacy form, and in the canonical one.
ALIAS_CLASS = r"[\s【】\[\]():]+"
CANONICAL_CLASS = r"[\s\x{200b}-\x{200d}\x{feff}【】\[\](){}<>:、,;/\\\"'“”‘’`]+"
#: What a shown alias has not at its ends.
ALIAS_ENDS = "【】[](){}<>:、,;"


def alias_key(text: Column | str, canonical: bool = False) -> Column:
    """One spelling of an alias: compatibility form, case folded, without blanks, brackets and colons (in the canonical form without any such sign)."""
    without = CANONICAL_CLASS if canonical else ALIAS_CLASS
    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", r"\\u\1", without))
    return _unicode(text, F.regexp_replace(F.lower(col(text)), without, ""), lambda t: pattern.sub("", unicodedata.normalize("NFKC", t).strip().casefold()))


def without_ends(text: Column) -> Column:
    """A normalised alias without blanks at its ends and then without punctuation there."""
    ends = f"[{re.escape(ALIAS_ENDS)}]+"
    return F.regexp_replace(F.regexp_replace(stripped(text), f"^{ends}", ""), rf"{ends}\z", "")


def shown_alias(text: Column | str) -> Column:
    """Compatibility form, without blanks at its ends and then without punctuation there."""
    return _unicode(text, without_ends(col(text)), lambda t: unicodedata.normalize("NFKC", t).strip().strip(ALIAS_ENDS))


def without_residue(text: Column | str) -> Column:
    """Without NUL; a run of replacement characters becomes one."""
    return F.regexp_replace(F.replace(col(text), F.lit("\x00"), F.lit("")), "�{2,}", "�")


def signed(text: Column, sign: str) -> Column:
    """Whether a text holds a sign: one of some words, by plain searches, or a pattern that begins with a class."""
    return text.rlike(sign) if sign.startswith("[") else reduce(lambda a, w: a | F.contains(text, F.lit(w)), sign.split("|"), F.lit(False))


def _replaced(text: Column, sign: str, pattern: str) -> Column:
    """A pattern's matches as blanks; texts without its sign are left alone."""
    return let(text, lambda t: F.when(signed(t, sign), F.regexp_replace(t, pattern, " ")).otherwise(t))


def without_contact_patterns(text: Column) -> Column:
    return reduce(lambda t, x: _replaced(t, x[0], "(?i)" + x[1]), zip(SIGNS, CONTACTS, strict=True), text)


def without_contacts(text: Column | str) -> Column:
    """Licence numbers, mail addresses, telephones and sites become blanks, and so do page marks (n/m)."""
    return _replaced(without_contact_patterns(col(text)), "/", r"\b\d+\s*/\s*\d+\b")


def has_contacts(text: Column | str) -> Column:
    """Whether contacts, licence numbers or the words of a disclaimer are left."""
    # blanks between its characters would not hide a residue, so one of its characters is looked for first
    words = signed(col(text), "|".join(sorted({w[0] for w in RESIDUES}))) & F.regexp_replace(col(text), r"\s+", "").rlike("|".join(RESIDUES))
    return reduce(lambda a, x: a | (signed(col(text), x[0]) & col(text).rlike("(?i)" + x[1])), zip(SIGNS, CONTACTS, strict=True), words)


def compacted(text: Column | str) -> Column:
    """Blanks collapsed, none before closing or after opening marks, and no blanks or weak marks at the ends."""
    out = F.regexp_replace(F.regexp_replace(col(text), r"[ \t]+", " "), rf"\s+([{CLOSING}])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, rf"([{OPENING}])\s+", "$1"), rf"\s+([{BRACKETS}])", "$1")
    return F.regexp_replace(out, rf"^[{ENDS}]+|[{ENDS}]+\z", "")


def clean_quote(text: Column | str, sites: tuple[str, ...] = (), noise: tuple[str, ...] = QUOTE_NOISE) -> Column:
    """An evidence quote without page marks, sites, boilerplate, blanks between CJK characters, and blanks before punctuation."""
    out = F.regexp_replace(col(text), r"(?i)\[PAGE\s+\d+\]", " ")
    for site in sites:
        out = F.regexp_replace(out, "(?i)" + re.escape(site), " ")
    out = F.regexp_replace(out, r"\b\d+\s*/\s*\d+\b", " ")
    for words in noise:
        out = F.replace(out, F.lit(words), F.lit(" "))
    out = F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), rf"(?<={CJK})\s+(?={CJK})", "")
    return F.trim(F.regexp_replace(out, r"\s+([，。；：！？!?%])", "$1"))


def reason_label(reason: Column | str) -> Column:
    """The label of what stands before ':'; without one, the reason itself."""
    labels = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.coalesce(labels[F.split_part(col(reason), F.lit(":"), F.lit(1))], F.nullif(col(reason), F.lit("")), F.lit("未知原因"))


def contract(text: Column | str, symbols: tuple[str, ...], least: int = 3) -> Column:
    """The first code of one to three letters and `least` to four digits whose letters are a symbol, else the first two to four digits before 合约."""
    codes = F.regexp_extract_all(col(text), F.lit(rf"\b([A-Za-z]{{1,3}}\d{{{least},4}})\b"), 1)
    known = F.get(F.filter(codes, lambda c: F.lower(F.regexp_replace(c, r"\d", "")).isin(*symbols)), F.lit(0))
    return F.coalesce(known, F.nullif(F.regexp_extract(col(text), r"([0-9]{2,4})\s*合约", 1), F.lit("")))


def first_number(text: Column | str) -> Column:
    return F.regexp_extract(col(text), r"[+-]?\d+(\.\d+)?", 0).try_cast("double")


def sentences(text: Column | str, marks: str = "。！？；\n") -> Column:
    """Sentences with their end mark, blank ones left out."""
    return F.filter(F.regexp_extract_all(col(text), F.lit(f"([^{marks}]*[{marks}]|[^{marks}]+)"), 1), lambda s: F.trim(F.regexp_replace(s, r"\s+", "")) != "")


def block_fingerprint(heading: Column, start: Column, end: Column, text: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", heading, start, end, F.left(F.regexp_replace(col(text), r"\s+", ""), F.lit(500))), 256)


def signal_id(*parts: Column | str) -> Column:
    return F.left(F.sha1(F.concat_ws("|", *parts)), F.lit(16))


def cjk_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(CJK)).cast("long")


def analyzable(text: Column | str, hints: tuple[str, ...] = HINTS, least: int = 30) -> Column:
    """Beside headings and source lines there is a hint word, or enough CJK characters."""
    lines = F.filter(F.transform(F.split(col(text), "\n"), F.trim), lambda x: ~x.rlike("^(#|来源文件:|解析器:)"))
    body = F.array_join(lines, "\n")
    return reduce(lambda a, x: a | x, (F.contains(body, F.lit(h)) for h in hints)) | (cjk_count(body) >= least)


def meaningful(text: Column | str, least: int = 200) -> Column:
    """At least 20 characters beside source lines, of which 4 CJK, or `least` in all."""
    body = F.trim(F.regexp_replace(col(text), r"(?m)^(来源文件|解析器):.*$", ""))
    return (F.length(body) >= 20) & ((cjk_count(body) >= 4) | (F.length(body) >= least))


def symbol_ratio(text: Column | str, letters: str = CJK) -> Column:
    """Share of the characters beside blanks that are neither letters nor digits; 1 if there are none."""
    bare = F.regexp_replace(col(text), r"\s+", "")
    return F.coalesce(F.try_divide(F.regexp_count(bare, F.lit(f"[^A-Za-z0-9{letters[1:]}")), F.length(bare)), F.lit(1.0))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def context_flags(before: Column | str, after: Column | str | None = None, packs: dict = CONTEXT, risks: tuple = RISKS) -> Column:
    """Names of the packs that have a word in the last characters before a span; with what follows it, also whether a risk is named around it."""
    flags = [F.when(_any(F.right(col(before), F.lit(n)), words), name) for name, (n, _, words) in packs.items()]
    if after is not None:
        around = F.concat(F.right(col(before), F.lit(risks[0])), F.left(col(after), F.lit(risks[0])))
        flags.append(F.when(_any(around, risks[1]), "risk_context"))
    return F.array_compact(F.array(*flags))


def _product(flags: Column | str, factors: dict[str, float]) -> Column:
    return F.round(reduce(lambda a, x: a * x, (F.when(F.array_contains(col(flags), name), weight).otherwise(1.0) for name, weight in factors.items())), 9)


def context_factor(flags: Column | str, packs: dict = CONTEXT) -> Column:
    """What a signal counts in arbitration."""
    return _product(flags, {name: weight for name, (_, weight, _) in packs.items()} | {"risk_context": RISK_FACTOR})


def signal_factor(flags: Column | str, factors: dict = SIGNAL_FACTORS) -> Column:
    """How sure a signal itself is."""
    return F.least(F.greatest(_product(flags, factors), F.lit(0.05)), F.lit(1.0))


def dense_paragraphs(text: Column | str, letters: str = CJK, shortest: int = 10, density: float = 0.15) -> Column:
    """Paragraphs long and dense enough in `letters`."""
    share = lambda p: F.regexp_count(p, F.lit(letters)) / F.length(p)
    return F.filter(F.split(col(text), "\n\n"), lambda p: (F.length(p) >= shortest) & (share(p) >= density))


# Kinds of parsers by extension, and by what a file is said to be.
EXTENSIONS = {"pdf": "pdf", "html": "html", "htm": "html", "png": "image", "jpg": "image", "jpeg": "image", "bmp": "image", "tiff": "image", "tif": "image", "webp": "image", "gif": "image"}
MIME_TYPES = {"application/pdf": "pdf", "text/html": "html", "image/png": "image", "image/jpeg": "image", "image/bmp": "image", "image/tiff": "image", "image/webp": "image", "image/gif": "image"}


def parser_type(url: Column | str, file_type: Column | str | None = None) -> Column:
    """The parser for a file: by its type (a kind, a MIME type or an extension), else by the address's extension, query string aside; else unknown."""
    of = lambda pairs, key: F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]
    extension = F.regexp_extract(F.split_part(F.lower(col(url)), F.lit("?"), F.lit(1)), r"\.([a-z0-9]+)\z", 1)
    by_url = of(EXTENSIONS, extension)
    if file_type is None:
        return F.coalesce(by_url, F.lit("unknown"))
    said = F.trim(F.lower(col(file_type)))
    kinds = {k: k for k in ("pdf", "html", "image", "unknown")}
    return F.coalesce(of(kinds | MIME_TYPES | EXTENSIONS, F.regexp_replace(said, r"^\.+", "")), by_url, F.lit("unknown"))
