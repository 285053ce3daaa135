"""Column functions: predicates, keys, text clean-up, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.sources.bindings import BEARISH, BULLISH, UNKNOWN_PRODUCT


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with some columns that are computed once each, here: a generator makes them, and neither later filters nor projections copy what they are made of."""
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[x.alias(name) for name, x in columns.items()]))))


def displayable(product: Column | str = "product") -> Column:
    """Product is neither blank nor the unknown one; null is not displayable."""
    name = F.trim(col(product))
    return F.coalesce((name != "") & (name != UNKNOWN_PRODUCT), F.lit(False))


def formal(product: Column | str = "product", review: Column | str = "need_manual_review") -> Column:
    return displayable(product) & ~F.coalesce(col(review), F.lit(False))


def signed(direction: Column | str, confidence: Column | str) -> Column:
    d, c = col(direction), col(confidence)
    return F.when(d == BULLISH, c).when(d == BEARISH, -c).otherwise(F.lit(0.0))


def company_of(company: Column | str = "company", source: Column | str = "source") -> Column:
    """The company, else the source, else ''; blank counts as missing."""
    blank = F.lit("")
    return F.coalesce(F.nullif(col(company), blank), F.nullif(col(source), blank), blank)


def contract_key(contract: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.trim(col(contract))), "合约| ", ""), F.lit(""))


def legacy_product_key(name: Column | str) -> Column:
    return F.concat(F.lit("LEGACY."), F.left(F.sha1(F.trim(F.regexp_replace(col(name), r"\s+", " "))), F.lit(12)))


def path_date(path: Column | str, first: int = 2000, last: int = 2100) -> Column:
    """Date of the last path part of eight digits that is a real date in the given years."""
    parts = F.filter(F.reverse(F.split(col(path), "/")), lambda x: x.rlike("^[0-9]{8}$"))
    dates = F.filter(F.transform(parts, lambda x: F.try_to_timestamp(x, F.lit("yyyyMMdd")).cast("date")), lambda d: d.isNotNull() & F.year(d).between(first, last))
    return F.get(dates, F.lit(0))


def valid_time(time: Column | str, first: int = 2000, last: int = 2100) -> Column:
    return F.when(F.year(col(time)).between(first, last), col(time))


#: Blanks but the line end, as in a character class: Java's and RE2's own know ASCII alone, texts indent with U+3000.
BLANKS = r"\t\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same and the line end, as characters.
BLANK_SIGNS = "\n\t\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column | str) -> Column:
    """A text without blanks of any kind at its ends. Only the ends are looked at: a pattern would try each place."""
    return F.btrim(col(text), F.lit(BLANK_SIGNS))


def normalized_space(text: Column | str) -> Column:
    """LF line ends, at most one empty line between others, blanks collapsed and trimmed within lines."""
    out = F.regexp_replace(F.regexp_replace(col(text), r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, rf"[{BLANKS}]*\n[{BLANKS}]*", "\n"), r"\n{3,}", "\n\n")


def redacted(text: Column | str, secrets: tuple[str, ...] = (), most: int | None = None) -> Column:
    """Known secrets, bearer tokens, and the values of secret settings and parameters are replaced; then the text is capped."""
    out = col(text)
    for secret in filter(None, secrets):
        out = F.replace(out, F.lit(secret), F.lit("[REDACTED]"))
    out = F.regexp_replace(out, r"(?i)\bBearer\s+[^\s,;\"']+", "Bearer [REDACTED]")
    out = F.regexp_replace(out, r"(?i)([?&](?:api[_-]?key|access[_-]?token|token|secret|password)=)[^&\s]+", "$1[REDACTED]")
    out = F.regexp_replace(out, r"(?i)(\b(?:api[_-]?key|access[_-]?token|token|secret|password)\b\s*[:=]\s*)(?:\"[^\"]*\"|'[^']*'|[^\s,;&]+)", "$1[REDACTED]")
    return F.left(out, F.lit(most)) if most is not None else out


# Named entities and what they stand for.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&apos;": "'", "&#160;": " ", "&ensp;": " ", "&emsp;": "  ",
    "&ldquo;": '"', "&rdquo;": '"', "&lsquo;": "'", "&rsquo;": "'", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…",
}


def without_markup(text: Column | str) -> Column:
    """Named entities as their character, numeric ones and tags as blanks, blanks collapsed."""
    out = col(text)
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    out = F.regexp_replace(F.regexp_replace(out, "&#[0-9]+;|&#x[0-9a-fA-F]+;", " "), "</?[a-zA-Z][^>]*/?>", " ")
    return F.regexp_replace(out, " {2,}", " ")


def confidence_band(c: Column | str) -> Column:
    return F.when(col(c) >= 0.7, "high").when(col(c) >= 0.5, "mid").otherwise("low")
