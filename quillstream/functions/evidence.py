"""Evidence of results and review items: quotes out of JSON of several shapes, and their normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.columns import col, redacted, stripped
from quillstream.packs import BOILERPLATE

# What fields of evidence may hold.
SOURCES = ("segment", "cleaned_text", "raw_text", "analysis_reason", "manual")
MATCH_TYPES = ("reason", "keyword", "fallback", "manual", "llm_selected", "context")
KINDS = ("verified", "candidate_context")
ERROR_TYPES = (
    "request_timeout", "network_error", "http_error", "empty_sse_response", "provider_response_error", "invalid_json", "product_mismatch",
    "invalid_direction", "empty_reason", "invalid_confidence", "invalid_evidence", "unexpected_error",
)
MOST_QUOTE = 1200
_EXCERPT = "array<struct<quote:string,source:string,start_char:bigint,end_char:bigint,match_type:string,validated:boolean,raw_quote:string>>"


def review_quote(text: Column | str, markers=BOILERPLATE) -> Column:
    """A quote with blanks collapsed, capped; '' if it is an identifier or holds two marks of a site's frame."""
    quote = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    marks = F.size(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(quote, m)))
    useless = quote.rlike(r"(?i)^[a-z_][a-z0-9_:-]*\z") | (marks >= 2)
    return F.when(useless, "").otherwise(F.left(quote, F.lit(MOST_QUOTE)))


def _field(value: str, *names: str) -> str:
    """The first of some fields of a variant that is not empty, as SQL."""
    return "coalesce(" + ", ".join(f"nullif(try_variant_get({value}, '$.{n}', 'string'), '')" for n in names) + ", '')"


def _items(value: str) -> str:
    return f"transform(try_variant_get({value}, '$', 'array<variant>'), x -> CASE WHEN schema_of_variant(x) = 'STRING' THEN try_variant_get(x, '$', 'string') ELSE {_field('x', 'quote', 'text', 'excerpt')} END)"


def evidence_quotes(column: str, markers=BOILERPLATE) -> Column:
    """Quotes out of JSON text: a string, a list of strings or objects, or an object with excerpts or a text of its own."""
    v = f"try_parse_json({column})"
    kind = f"schema_of_variant({v})"
    excerpts = f"try_variant_get({v}, '$.excerpts', 'array<variant>')"
    inner = f"transform({excerpts}, x -> CASE WHEN schema_of_variant(x) = 'STRING' THEN try_variant_get(x, '$', 'string') ELSE {_field('x', 'quote', 'text', 'excerpt')} END)"
    raw = F.expr(
        f"CASE WHEN {kind} = 'STRING' THEN array(try_variant_get({v}, '$', 'string')) WHEN {kind} LIKE 'ARRAY%' THEN {_items(v)} "
        f"WHEN {excerpts} IS NOT NULL THEN {inner} WHEN {kind} LIKE 'OBJECT%' THEN array({_field(v, 'quote', 'text', 'excerpt', 'raw')}) ELSE array() END"
    )
    return F.filter(F.transform(raw, lambda x: review_quote(F.coalesce(x, F.lit("")), markers)), lambda x: x != "")


def normal_evidence(column: str, secrets: tuple[str, ...] = ()) -> Column:
    """struct<excerpts, kind, notes, error_type, message, attempts, parse_errors>: fields outside their lists go, numbers are not negative, diagnostics are redacted and capped."""
    v = f"try_parse_json({column})"
    excerpts = F.expr(f"filter(from_json({column}, 'excerpts array<string>').excerpts, x -> true)")
    parsed = F.transform(excerpts, lambda x: F.from_json(x, "quote string, text string, excerpt string, source string, start_char bigint, end_char bigint, match_type string, validated boolean, raw_quote string"))
    empty = F.lit("")
    listed = lambda x, values: F.when(x.isin(*values), x)
    not_negative = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0)))

    def one(x: Column, y: Column) -> Column:
        text = F.coalesce(F.nullif(y["quote"], empty), F.nullif(y["text"], empty), F.nullif(y["excerpt"], empty), F.when(~x.startswith("{"), x), empty)
        return F.struct(
            review_quote(text).alias("quote"), listed(y["source"], SOURCES).alias("source"), not_negative(y["start_char"]).alias("start_char"), not_negative(y["end_char"]).alias("end_char"),
            listed(y["match_type"], MATCH_TYPES).alias("match_type"), y["validated"].alias("validated"), F.nullif(redacted(y["raw_quote"], most=MOST_QUOTE), empty).alias("raw_quote"),
        )

    structured = F.filter(F.transform(F.arrays_zip(excerpts.alias("x"), parsed.alias("y")), lambda p: one(p["x"], p["y"])), lambda e: e["quote"] != "")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    plain = F.transform(evidence_quotes(column), lambda q: F.struct(q.alias("quote"), none("source", "string"), none("start_char", "bigint"), none("end_char", "bigint"), none("match_type", "string"), none("validated", "boolean"), none("raw_quote", "string")))
    get = lambda path, kind="string": F.expr(f"try_variant_get({v}, '{path}', '{kind}')")
    error = get("$.diagnostic.error_type")
    diagnosed = F.expr(f"try_variant_get({v}, '$.diagnostic', 'variant') IS NOT NULL")
    errors = F.expr(f"slice(transform(try_variant_get({v}, '$.diagnostic.parse_errors', 'array<variant>'), x -> coalesce(try_variant_get(x, '$.error_type', 'string'), 'unexpected_error')), 1, 10)")
    known = lambda x: F.when(x.isin(*ERROR_TYPES), x).otherwise("unexpected_error")
    return F.struct(
        F.coalesce(structured.cast(_EXCERPT), plain.cast(_EXCERPT)).alias("excerpts"),
        listed(get("$.kind"), KINDS).alias("kind"),
        F.nullif(redacted(F.trim(get("$.notes")), secrets, 500), empty).alias("notes"),
        F.when(diagnosed, known(F.coalesce(error, empty))).alias("error_type"),
        F.when(diagnosed, redacted(F.coalesce(get("$.diagnostic.message"), empty), secrets, 1000)).alias("message"),
        F.when(diagnosed, F.greatest(F.coalesce(get("$.diagnostic.attempt_count", "bigint"), F.lit(0)), F.lit(0))).alias("attempts"),
        F.transform(errors, known).alias("parse_errors"),
    )


def without_dangling_tail(text: Column | str, most: int = 32) -> Column:
    """A text cut to its last end of a sentence if a short rest without one follows."""
    x = stripped(text)
    cut = F.regexp_extract(x, r"^([\s\S]*[。！？；;])([^。！？；;]*)\z", 1)
    tail = stripped(F.regexp_extract(x, r"^([\s\S]*[。！？；;])([^。！？；;]*)\z", 2))
    whole = x.rlike(r"[。！？；.!?;”’」』]\z") | (cut == "")
    return F.when(whole, x).when(F.length(tail) <= most, cut).otherwise(x)
