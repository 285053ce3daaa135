"""Queries of the span operators over whole texts, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import phrases as ph
from quillstream.operators import proof, proven
from quillstream.operators import spans as sp
from quillstream.operators.tables import written
from quillstream.operators.text import ALIASES
from quillstream.sources import bindings as b

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

#: Packs for the driver's documents: a heading is a sentence's first word, negative words, signals.
HEADING = r"[.!?] [A-Z][a-z]*"
NEGATIVE = ("not", "nicht")
SIGNALS = {
    "direction_up": ("看涨", 1.0, "with|from|mit"),
    "direction_down": ("看跌", 1.0, "this|that|nicht"),
    "supply_up": ("看涨", 0.75, "with the|from the|mit der"),
    "neutral": ("中性", 0.5, "ist|is"),
}
CLAUSE, SENTENCE = r"[,;.!?\n]", r"[.!?\n]"
SENTENCES = r"[^.!?\n]+[.!?\n]?"
CONCLUSIONS = ("would", "aber")


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _docs(s, d) -> DataFrame:
    return b.table(s, d, "documents").select("doc_id", "text")


def _found(s, d) -> DataFrame:
    return sp.matches(_docs(s, d), ALIASES, NEGATIVE)


def _parts(s, d) -> DataFrame:
    return sp.sections(_docs(s, d), HEADING)


def _placed(s, d) -> DataFrame:
    return sp.placed(_found(s, d), _parts(s, d))


def _signals(s, d) -> DataFrame:
    values = lambda i: F.create_map(*[F.lit(x) for k, v in SIGNALS.items() for x in (k, v[i])])[F.col("kind")]
    found = sp.spans(_docs(s, d), {k: v[2] for k, v in SIGNALS.items()})
    return found.select("doc_id", "start", "stop", values(0).alias("direction"), values(1).alias("confidence"))


def _spans_sql(name: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""{name}_cut AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{p}')) AS phrase, length(unnest(string_split_regex(text, '{p}'))) AS gap, unnest(range(len(string_split_regex(text, '{p}')))) AS pos FROM documents),
    {name}_sum AS (SELECT doc_id, text, phrase, sum(gap + coalesce(length(phrase), 0)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM {name}_cut),
    {name} AS (SELECT doc_id, text, phrase, stop - length(phrase) AS start, stop, length(text) AS n FROM {name}_sum WHERE phrase IS NOT NULL)"""


_NAMES = "|".join(ALIASES)
_KEYS = " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in ALIASES.items())
_BARRED = " OR ".join(f"contains(lower(substring(text, greatest(start - 20, 0) + 1, start - greatest(start - 20, 0))), '{w}')" for w in NEGATIVE)
FOUND = (
    _spans_sql("runs", "[A-Za-z0-9]+")
    + f""", found AS (SELECT doc_id, CASE regexp_replace(lower(phrase), '[0-9]+$', '') {_KEYS} END AS product_key, start, stop, n FROM runs
    WHERE regexp_full_match(lower(phrase), '(?:{_NAMES})(?:[0-9]{{2,4}})?') AND NOT ({_BARRED}))"""
)
PARTS = _spans_sql("heads", HEADING) + ", parts AS (SELECT doc_id, start AS heading_start, stop AS body_start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) AS body_end FROM heads)"
PLACED = "placed AS (SELECT f.*, heading_start, body_start, body_end FROM found f ASOF LEFT JOIN parts p ON f.doc_id = p.doc_id AND f.start >= p.heading_start)"
OWNERS = "owners AS (SELECT DISTINCT doc_id, heading_start, product_key FROM placed WHERE start < body_start)"
SCOPES = """free AS (SELECT doc_id, product_key, greatest(start - 80, CASE WHEN start >= body_start THEN body_start ELSE 0 END) AS start, least(stop + 80, CASE WHEN start >= body_start THEN body_end ELSE n END) AS stop
      FROM placed p WHERE NOT EXISTS (SELECT 1 FROM owners o WHERE o.doc_id = p.doc_id AND o.product_key = p.product_key)),
    fresh AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY doc_id, product_key ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM free WHERE start < stop),
    isles AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, product_key ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS isle FROM fresh),
    scopes AS (SELECT doc_id, product_key, body_start AS start, body_end AS stop, true AS owned FROM owners JOIN parts USING (doc_id, heading_start)
      UNION ALL SELECT doc_id, product_key, min(start), max(stop), false FROM isles GROUP BY doc_id, product_key, isle)"""


@query("t1_lexicon_matches", f"WITH {FOUND} SELECT doc_id, product_key, start, stop FROM found")
def t1(s, d):
    return _found(s, d).select("doc_id", "product_key", "start", "stop")


@query("t4_sections", f"WITH {PARTS} SELECT * FROM parts")
def t4(s, d):
    return _parts(s, d)


@query("j7_section_of_match", f"WITH {FOUND}, {PARTS}, {PLACED} SELECT doc_id, product_key, start, heading_start, start < body_start AS in_heading FROM placed")
def j7(s, d):
    return _placed(s, d).select("doc_id", "product_key", "start", "heading_start", (F.col("start") < F.col("body_start")).alias("in_heading"))


@query("t5_product_scopes", f"WITH {FOUND}, {PARTS}, {PLACED}, {OWNERS}, {SCOPES} SELECT * FROM scopes")
def t5(s, d):
    return sp.scopes(_placed(s, d), _parts(s, d))


@query(
    "t6_related_only",
    f"""WITH {FOUND}, {PARTS}, {PLACED}, {OWNERS}, keys AS (SELECT doc_id, heading_start, list(product_key) AS keys FROM owners GROUP BY ALL)
    SELECT doc_id, product_key, count(*) AS n, bool_and(coalesce(start >= body_start AND keys IS NOT NULL AND NOT list_contains(keys, product_key), false)) AS related
    FROM placed LEFT JOIN keys USING (doc_id, heading_start) GROUP BY ALL""",
)
def t6(s, d):
    return sp.related_only(_placed(s, d))


_SIGNAL_SQL = ", ".join(_spans_sql(k, v[2]) for k, v in SIGNALS.items()) + ", signals AS (" + " UNION ALL ".join(f"SELECT doc_id, start, stop, '{v[0]}' AS direction, {v[1]}::DOUBLE AS confidence FROM {k}" for k, v in SIGNALS.items()) + ")"


@query("t8_pattern_signals", f"WITH {_SIGNAL_SQL} SELECT * FROM signals")
def t8(s, d):
    return _signals(s, d)


#: Words around signals of the driver's documents.
FLAGS = {"negated": (8, 0.25, ("no", "nicht")), "conditional": (15, 0.65, ("if", "en")), "historical": (15, 0.45, ("er", "last")), "after_turn": (12, 0.75, ("but", "st"))}
RISKS = (30, ("tion", "risk"))


def _flag(name: str) -> str:
    n, _, words = FLAGS[name]
    return f"regexp_matches(right(before, {n}), '{'|'.join(words)}')"


_RISK = f"regexp_matches(before || after, '{'|'.join(RISKS[1])}')"
_FLAGS = ", ".join(f"CASE WHEN {_flag(n)} THEN '{n}' END" for n in FLAGS) + f", CASE WHEN {_RISK} THEN 'risk_context' END"
_FACTOR = " * ".join(f"CASE WHEN {_flag(n)} THEN {w} ELSE 1.0 END" for n, (_, w, _) in FLAGS.items()) + f" * CASE WHEN {_RISK} THEN {ph.RISK_FACTOR} ELSE 1.0 END"
_SURE = " * ".join(f"CASE WHEN {_flag(n) if n in FLAGS else _RISK} THEN {w} ELSE 1.0 END" for n, w in ph.SIGNAL_FACTORS.items())
FLAGGED = f"""around AS (SELECT s.*, substring(text, greatest(start - 30, 0) + 1, start - greatest(start - 30, 0)) AS before, substring(text, stop + 1, 30) AS after FROM signals s JOIN documents USING (doc_id)),
    flagged AS (SELECT doc_id, start, stop, direction, confidence, concat_ws(',', {_FLAGS}) AS flags, round(({_FACTOR})::DOUBLE, 9) AS factor, least(greatest(round(({_SURE})::DOUBLE, 9), 0.05), 1.0) AS sure FROM around)"""


def _flagged(s, d):
    return sp.with_context(_docs(s, d), _signals(s, d), FLAGS, RISKS)


def _weighed(s, d):
    """Signals as sure as their context lets them be, with what their kind weighs and what their context leaves of it."""
    return _flagged(s, d).select("doc_id", "start", "stop", "direction", F.col("sure").alias("confidence"), F.col("confidence").alias("weight"), "factor")


@query("t9_context_flags", f"WITH {_SIGNAL_SQL}, {FLAGGED} SELECT doc_id, start, stop, direction, flags, factor, sure FROM flagged")
def t9(s, d):
    return _flagged(s, d).select("doc_id", "start", "stop", "direction", F.array_join("flags", ",").alias("flags"), "factor", "sure")


def _unit(of: str, marks: str, name: str) -> str:
    return f"SELECT x.*, coalesce(m.k, 0) AS {name} FROM {of} x ASOF LEFT JOIN (SELECT doc_id, start + 1 AS at, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k FROM {marks}) m ON x.doc_id = m.doc_id AND x.start >= m.at"


def _nearest_sql(unit: str) -> str:
    return f"""{unit}_pool AS (SELECT s.sid, a.product_key, a.stop <= s.start AS before, CASE WHEN a.stop <= s.start THEN s.start - a.stop ELSE abs(s.start - a.start) END AS far FROM s2 s JOIN a2 a ON s.doc_id = a.doc_id AND s.{unit} = a.{unit}),
    {unit}_best AS (SELECT *, rank() OVER (PARTITION BY sid ORDER BY before DESC, far) AS r FROM {unit}_pool),
    {unit}_owner AS (SELECT sid, min(product_key) AS owner FROM {unit}_best WHERE r = 1 GROUP BY sid HAVING min(product_key) = max(product_key))"""


@query(
    "j8_signal_owners",
    f"""WITH {FOUND}, {_SIGNAL_SQL}, {_spans_sql("clauses", CLAUSE)}, {_spans_sql("sents", SENTENCE)},
    s0 AS (SELECT *, row_number() OVER () AS sid FROM signals), s1 AS ({_unit("s0", "clauses", "clause")}), s2 AS ({_unit("s1", "sents", "sentence")}),
    a1 AS ({_unit("found", "clauses", "clause")}), a2 AS ({_unit("a1", "sents", "sentence")}), {_nearest_sql("clause")}, {_nearest_sql("sentence")}
    SELECT doc_id, start, stop, direction, coalesce(c.owner, t.owner) AS owner FROM s2 LEFT JOIN clause_owner c USING (sid) LEFT JOIN sentence_owner t USING (sid)""",
)
def j8(s, d):
    return sp.owned_signals(_docs(s, d), written(_signals(s, d)), written(_found(s, d)), CLAUSE, SENTENCE).select("doc_id", "start", "stop", "direction", "owner")


@query("w13_leftmost_longest")
def w13(s, d):
    return sp.leftmost_longest(_signals(s, d).select("doc_id", "start", "stop").distinct(), "doc_id")


@query("w14_longest_first")
def w14(s, d):
    return sp.longest_first(_signals(s, d), "doc_id")


def _places(s, d) -> tuple[DataFrame, DataFrame]:
    """Matches with their headings, and the headings' sections: places alone, which every step reads, so they are written once."""
    parts = written(_parts(s, d))
    return written(sp.placed(_found(s, d), parts)), parts


def _product_signals(s, d, places: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    placed, parts = places or _places(s, d)
    return sp.product_signals(_docs(s, d), placed, parts, written(_weighed(s, d)), clause=CLAUSE, sentence=SENTENCE)


@query("t7_product_signals")
def t7(s, d):
    return _product_signals(s, d)


def _evidence(s, d):
    return sp.evidence(_docs(s, d), _found(s, d), sentence=SENTENCES, conclusions=CONCLUSIONS)


@query("t12_mention_sentences")
def t12_mentions(s, d):
    return _evidence(s, d)


def _area(s, d, places: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Scopes, and whether several concrete products own one together."""
    placed, parts = places or _places(s, d)
    owners = sp.owners(placed).filter(~F.col("product_key").startswith("GROUP.")).groupBy("doc_id", "heading_start").agg((F.count("*") > 1).alias("shared"))
    heads = parts.join(owners, ["doc_id", "heading_start"]).select("doc_id", F.col("body_start").alias("start"), "shared")
    area = sp.scopes(placed, parts).join(heads, ["doc_id", "start"], "left")
    return written(area.select("doc_id", "product_key", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"), (F.col("owned") & F.coalesce("shared", F.lit(False))).alias("shared")))


ENDS, COMPARED, BOILER = ".!?", ("would", "with"), ("licensed", "cookie")


@query("t12_evidence")
def t12(s, d):
    places = _places(s, d)
    return _candidates(s, d, places[0], _area(s, d, places))


def _candidates(s, d, placed: DataFrame, area: DataFrame) -> DataFrame:
    return proof.candidates(_docs(s, d), placed, area, endings=ENDS, conclusions=CONCLUSIONS, boilerplate=BOILER)


RULES = proven.Rules(ALIASES, NEGATIVE, HEADING, SIGNALS, FLAGS, RISKS, CLAUSE, SENTENCE, ENDS)
CLAUSES = ",;.!?\n"


@query("t11_evidence_sentences")
def t11(s, d):
    return proven.proofs(_docs(s, d), RULES, CLAUSES, COMPARED)


@query("a12_signals_by_product")
def a12(s, d):
    """Signals once each, by product."""
    once = _product_signals(s, d).select("doc_id", "product_key", "start", "stop", "direction").distinct()
    return once.groupBy("doc_id", "product_key").agg(F.count("*").alias("n"), F.count_if(F.col("direction") == b.BULLISH).alias("bullish"), F.count_if(F.col("direction") == b.BEARISH).alias("bearish"))


_EXCERPT = "SELECT doc_id, (doc_id % 50)::BIGINT AS start, (doc_id % 50 + 20)::BIGINT AS stop, substring(text, (doc_id % 49 + 1)::BIGINT, 20) AS raw_quote FROM documents"


@query("t13_valid_excerpts", f"WITH e AS ({_EXCERPT}) SELECT doc_id, start, stop, substring(text, start + 1, stop - start) = raw_quote AS valid FROM e JOIN documents USING (doc_id)")
def t13(s, d):
    docs, at = _docs(s, d), F.col("doc_id") % 50
    quotes = docs.select("doc_id", at.cast("long").alias("start"), (at + 20).cast("long").alias("stop"), F.substring("text", (F.col("doc_id") % 49 + 1).cast("int"), F.lit(20)).alias("raw_quote"))
    return sp.valid_excerpts(docs, quotes).select("doc_id", "start", "stop", "valid")


def _verdicts(s, d) -> DataFrame:
    from quillstream.operators.text import arbitrated

    signals = _product_signals(s, d).select(F.col("doc_id").alias("article_id"), "product_key", "direction", "weight", "confidence", "factor")
    return arbitrated(signals).withColumnRenamed("article_id", "doc_id")


@query("t14_routing")
def t14(s, d):
    return proven.routed(_docs(s, d), RULES, CLAUSES, COMPARED, BOILER)


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL
