"""Queries of the text, rule, lexicon and streaming operators, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillstream.functions import columns as fn
from quillstream.operators import text
from quillstream.packs import DRIVER_DIRECTIONS as PACK
from quillstream.plans.relational import WITH
from quillstream.sources import bindings as b
from quillstream.streaming import jobs

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _docs(s, d):
    return b.table(s, d, "documents")


NOISY = "(" + " OR ".join(f"contains(lower(x), '{w}')" for w in text.NOISE) + ")"
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
WORDS = "words AS (SELECT doc_id, pos, regexp_replace(raw, '^[.,!?;:]+|[.,!?;:]+$', '', 'g') AS word FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[ \\n]')) AS raw, generate_subscripts(string_split_regex(lower(text), '[ \\n]'), 1) - 1 AS pos FROM documents))"
MENTIONS = "mentions AS (SELECT doc_id, pos, CASE " + " ".join(f"WHEN word = '{a}' THEN '{k}'" for a, k in text.ALIASES.items()) + " END AS product_key FROM words)"


@query("c1_clean_stats", f"""WITH {LINES}, k AS (SELECT doc_id, count(*) FILTER ({NOISY}) AS removed_lines, coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (NOT {NOISY}), '') AS c FROM lines GROUP BY doc_id),
  r AS (SELECT doc_id, length(text) AS raw_length, removed_lines, length(c) AS cleaned_length, coalesce(round(1 - length(c) / nullif(length(text), 0), 6), 0) AS ratio FROM k JOIN documents USING (doc_id))
  SELECT *, CASE WHEN ratio > 0.95 THEN 'high' WHEN ratio < 0.05 THEN 'low' ELSE 'none' END AS warning FROM r""")
def c1(s, d):
    return text.clean_stats(_docs(s, d))


@query("w9_adjacent_lines", f"WITH {LINES}, n AS (SELECT doc_id, pos, regexp_replace(x, '\\s+', '', 'g') AS bare FROM lines), l AS (SELECT *, lag(bare) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM n WHERE bare <> '') SELECT doc_id, count(*) AS kept FROM l WHERE before IS NULL OR before <> bare GROUP BY doc_id")
def w9(s, d):
    return text.adjacent_distinct(text.lines(_docs(s, d))).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("w10_line_runs", f"WITH {LINES}, f AS (SELECT doc_id, pos, length(x) < 60 AS flag FROM lines), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, flag ORDER BY pos) AS island FROM f), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, flag, island) AS size FROM i) SELECT doc_id, count(*) AS n FROM c WHERE flag AND size >= 2 GROUP BY doc_id")
def w10(s, d):
    return text.long_runs(text.lines(_docs(s, d)), F.length("line") < 60).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("a11_mention_counts", f"WITH {WORDS}, {MENTIONS} SELECT doc_id, product_key, count(*) AS n, min(pos)::BIGINT AS first_pos FROM mentions WHERE product_key IS NOT NULL GROUP BY ALL")
def a11(s, d):
    return text.mention_counts(_docs(s, d))


@query(
    "w11_merged_windows",
    f"""WITH {WORDS}, {MENTIONS}, s AS (SELECT doc_id, product_key, pos, greatest(pos - 3, 0) AS start, pos + 4 AS stop, pos % 5 AS score, CASE WHEN pos % 7 = 0 THEN 'reason' ELSE 'keyword' END AS kind FROM mentions WHERE product_key IS NOT NULL),
    f AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY doc_id, product_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2, true) AS fresh FROM s),
    g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, product_key ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM f)
    SELECT doc_id, product_key, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop, count(*) AS hits, sum(score)::BIGINT AS score, CASE WHEN bool_or(kind = 'reason') THEN 'reason' ELSE 'keyword' END AS kind FROM g GROUP BY doc_id, product_key, g""",
)
def w11(s, d):
    scored = text.mentions(_docs(s, d)).withColumns({"score": F.col("pos") % 5, "kind": F.when(F.col("pos") % 7 == 0, "reason").otherwise("keyword")})
    return text.merged_windows(scored, 3, 2)


def _counted(patterns) -> list[str]:
    return [f"len(regexp_extract_all(text, '{p}'))" for p in patterns]


_STRONG = {n: _counted(map(re.escape, w)) for n, w in (("up", PACK.up), ("down", PACK.down), ("flat", PACK.flat))}
_WEAK = {n: _counted(w) for n, w in (("up", PACK.up_weak), ("down", PACK.down_weak), ("flat", PACK.flat_weak))}
_SOME = lambda lists: " + ".join(f"({x} > 0)::INT" for own in lists.values() for x in own)


def directions_sql(source: str, keys: str) -> str:
    """CTEs that end in `ruled`: keys, counts, direction, conflict, confidence, need_llm of the texts of a source."""
    return f"""dc AS (SELECT {keys}, {", ".join(f"{' + '.join(_STRONG[n] + _WEAK[n])} AS {n}" for n in _STRONG)}, {_SOME(_STRONG)} AS strong, {_SOME(_WEAK)} AS weak FROM {source}),
    dt AS (SELECT *, CASE WHEN greatest(up, down, flat) = 0 THEN NULL WHEN up = greatest(up, down, flat) THEN '看涨' WHEN down = greatest(up, down, flat) THEN '看跌' ELSE '中性' END AS direction, up > 0 AND down > 0 AS conflict FROM dc),
    dr AS (SELECT *, 0.5 + 0.15 * strong - 0.1 * weak - CASE WHEN conflict THEN 0.25 ELSE 0 END + CASE WHEN strong >= 2 AND NOT conflict THEN 0.1 * (strong - 1) ELSE 0 END AS raw FROM dt),
    dn AS (SELECT *, CASE WHEN direction = '中性' THEN least(raw, 0.6) ELSE raw END AS capped FROM dr),
    ds AS (SELECT * EXCLUDE (raw, capped), CASE WHEN direction IS NULL THEN 0 ELSE least(greatest(round(CASE WHEN strong = 0 AND weak > 0 THEN least(capped, 0.55) ELSE capped END, 2), 0), 1) END::DOUBLE AS confidence FROM dn),
    ruled AS (SELECT *, confidence < 0.7 OR direction IS NULL OR conflict AS need_llm FROM ds)"""


@query("g6_directions", f"WITH {directions_sql('documents', 'doc_id')} SELECT * FROM ruled")
def g6(s, d):
    return text.directions(_docs(s, d).select("doc_id", "text"), PACK).drop("text")


SIGNALS = "signals AS (SELECT article_id, product_key, direction, CASE method WHEN 'manual' THEN 1.0 WHEN 'rule' THEN 0.8 ELSE 0.45 END AS weight, CASE id % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.455 ELSE 1.0 END AS factor, confidence FROM results)"
_SUM = lambda d: f"round(sum(CASE WHEN direction = '{d}' THEN weight * confidence * factor ELSE 0 END), 9)"


@query(
    "a13_arbitration",
    f"""{WITH}, {SIGNALS}, s AS (SELECT article_id, product_key, {_SUM("看涨")} AS up, {_SUM("看跌")} AS down, {_SUM("中性")} AS flat FROM signals GROUP BY ALL),
    r AS (SELECT *, greatest(up, down, flat) AS best, round(greatest(up, down, flat) - list_reverse_sort([up, down, flat])[2], 9) AS margin, up + down + flat AS total FROM s),
    v AS (SELECT article_id, product_key, CASE WHEN up = best THEN '看涨' WHEN down = best THEN '看跌' ELSE '中性' END AS direction, round(least(1.0, coalesce(best / nullif(total, 0), 0) + least(margin, 1.0) * 0.15), 4) AS confidence,
    ((best >= 1.5 AND margin >= 0.5) OR margin >= 0.2) AND NOT (up >= 0.75 AND down >= 0.75 AND margin < 1) AS accepted FROM r), m AS (SELECT DISTINCT article_id, product_key FROM results UNION SELECT article_id, 'K99' FROM articles WHERE article_id % 5 = 0)
    SELECT article_id, product_key, direction, confidence, accepted, CASE WHEN accepted IS NULL THEN 'no_signal' WHEN accepted THEN 'rule_accept' ELSE 'llm_fallback' END AS decision FROM m LEFT JOIN v USING (article_id, product_key)""",
)
def a13(s, d):
    i = F.col("id")
    weight = F.when(F.col("method") == "manual", 1.0).when(F.col("method") == "rule", 0.8).otherwise(0.45)
    rows = b.results(s, d).withColumns({"weight": weight, "factor": F.when(i % 4 == 0, 0.25).when(i % 4 == 1, 0.455).otherwise(1.0)})
    mentions = rows.select("article_id", "product_key").unionByName(b.articles(s, d).filter("article_id % 5 = 0").select("article_id", F.lit("K99").alias("product_key")))
    return text.decided(text.arbitrated(rows), mentions)


_KINDS = "['contract_code', 'suffix_pattern', 'bracket_heading', 'market_context', 'symbol_context', 'catalog_alias', 'label_field']"
CANDIDATES = f"""occ AS (SELECT reason || contract_key AS alias, ({_KINDS})[id % 7 + 1] AS kind, product_key, article_id, id % 9 = 4 AS negative FROM results),
    cand AS (SELECT alias, coalesce(list(DISTINCT kind) FILTER (NOT negative), []) AS kinds, count(DISTINCT article_id) FILTER (NOT negative) AS docs, count(*) FILTER (NOT negative) AS occurrences, coalesce(list(DISTINCT product_key) FILTER (NOT negative AND id2 <> 0), []) AS keys, CASE WHEN bool_or(negative) THEN ['foreign_market_context'] ELSE [] END AS negative, CASE WHEN contains(alias, '7') THEN 'K7' END AS seed FROM (SELECT *, length(alias) % 3 AS id2 FROM occ) GROUP BY alias)"""
_HAS = lambda group: "list_has_any(kinds, [" + ", ".join(f"'{x}'" for x in group) + "])"
_CLASSES = f"{_HAS(text.SHAPE)}::INT + {_HAS(text.CATALOG)}::INT + {_HAS(text.CONTEXT)}::INT"


@query(
    "l4_candidate_status",
    f"""{WITH}, {CANDIDATES}, r AS (SELECT *, CASE WHEN {_HAS(text.HIGH_VALUE)} THEN 0.44 ELSE 0 END + CASE WHEN {_HAS(text.SHAPE)} THEN 0.22 ELSE 0 END + CASE WHEN {_HAS(text.CATALOG)} THEN 0.24 ELSE 0 END + CASE WHEN {_HAS(text.CONTEXT)} THEN 0.18 ELSE 0 END + least(0.12, 0.04 * docs)
      + CASE WHEN occurrences >= 3 THEN 0.05 ELSE 0 END - CASE WHEN len(keys) > 1 THEN 0.28 ELSE 0 END - CASE WHEN len(negative) > 0 THEN 0.5 ELSE 0 END AS raw, {_CLASSES} AS classes FROM cand),
    s AS (SELECT *, CASE WHEN len(negative) > 0 AND occurrences = 0 THEN 0 ELSE round(least(greatest(CASE WHEN classes < 2 AND NOT {_HAS(("bracket_heading", "label_field"))} THEN least(raw, 0.55) ELSE raw END, 0), 1), 4) END::DOUBLE AS score, coalesce(seed, CASE WHEN len(keys) = 1 THEN keys[1] END) AS suggested FROM r),
    t AS (SELECT *, regexp_full_match(alias, '[一-鿿A-Za-z0-9]{{2,12}}') AND NOT regexp_full_match(alias, '\\d+') AND (regexp_matches(alias, '[一-鿿]') OR len(regexp_extract_all(alias, '[A-Za-z]')) >= 2) AND {_HAS(text.FUTURES)} AND {_HAS(text.ANCHORS)} AND docs >= 2 AS ok FROM s)
    SELECT alias, docs, occurrences, score, suggested, CASE WHEN len(negative) > 0 AND (occurrences = 0 OR score < 0.35) THEN 'rejected' WHEN seed IS NOT NULL THEN 'approved_seed' WHEN suggested IS NOT NULL AND classes >= 2 AND score >= 0.72 THEN 'auto_approved' WHEN suggested IS NOT NULL AND score >= 0.35 THEN 'review_required'
      WHEN suggested IS NULL AND NOT ok THEN 'rejected' WHEN score >= 0.35 THEN 'review_required' ELSE 'rejected' END AS status FROM t""",
)
def l4(s, d):
    i = F.col("id")
    kinds = F.array(*map(F.lit, ("contract_code", "suffix_pattern", "bracket_heading", "market_context", "symbol_context", "catalog_alias", "label_field")))
    seen = b.results(s, d).select(F.concat("reason", "contract_key").alias("alias"), F.get(kinds, (i % 7).cast("int")).alias("kind"), "product_key", "article_id", (i % 9 == 4).alias("no"))
    good = ~F.col("no")
    rows = seen.groupBy("alias").agg(
        F.collect_set(F.when(good, F.col("kind"))).alias("kinds"), F.count_distinct(F.when(good, F.col("article_id"))).alias("docs"), F.count_if(good).alias("occurrences"),
        F.collect_set(F.when(good & (F.length("alias") % 3 != 0), F.col("product_key"))).alias("keys"), F.collect_set(F.when(F.col("no"), "foreign_market_context")).alias("negative"),
    )
    rows = rows.withColumn("seed", F.when(F.contains("alias", F.lit("7")), "K7"))
    return text.candidate_status(rows).select("alias", "docs", "occurrences", "score", "suggested", "status")


@query("x6_whitespace", "SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents")
def x6(s, d):
    return _docs(s, d).select("doc_id", F.sha2(fn.normalized_space("text"), 256).alias("digest"))


@query("r1_batches", "SELECT event_type, count(*) AS n FROM events WHERE value >= 1 GROUP BY event_type")
def r1(s, d):
    rows = jobs.in_batches(jobs.arrivals(s, d, "events"), lambda batch: batch.filter("value >= 1").select("event_id", "event_type"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query("r2_once_only", "SELECT DISTINCT user_id, event_type FROM events")
def r2(s, d):
    return jobs.once_only(jobs.arrivals(s, d, "events"), ["user_id", "event_type"])


@query("r4_running_trend", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value) / count(*), 4) AS value, count(*) AS n FROM events GROUP BY day")
def r4(s, d):
    return jobs.running_trend(jobs.arrivals(s, d, "events"), "ts", "value")


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL
