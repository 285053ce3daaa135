"""Span operators that SQL does not express, against plain loops."""

from collections import defaultdict

from pyspark.sql import functions as F

from quillstream.operators import spans as sp
from quillstream.plans import spanned


def kept(rows, key):
    out = []
    for r in sorted(rows, key=key):
        if not any(r[0] < y[1] and y[0] < r[1] for y in out):
            out.append(r)
    return sorted(out)


def by_doc(rows):
    out = defaultdict(list)
    for doc, *rest in rows:
        out[doc].append(tuple(rest))
    return {k: sorted(v) for k, v in out.items()}


def test_leftmost_longest(spark, sf_dir):
    spans = by_doc(spanned._signals(spark, sf_dir).select("doc_id", "start", "stop").distinct().collect())
    ours = by_doc(spanned.w13(spark, sf_dir).select("doc_id", "start", "stop").collect())
    assert ours == {d: kept(v, lambda s: (s[0], s[0] - s[1])) for d, v in spans.items()}


def test_longest_first(spark, sf_dir):
    best = defaultdict(dict)
    for doc, start, stop, direction, confidence in spanned._signals(spark, sf_dir).select("doc_id", "start", "stop", "direction", "confidence").collect():
        best[doc][start, stop, direction] = max(confidence, best[doc].get((start, stop, direction), 0.0))
    ours = by_doc(spanned.w14(spark, sf_dir).select("doc_id", "start", "stop", "direction", "confidence").collect())
    assert ours == {d: kept([(*k, c) for k, c in v.items()], lambda s: (s[0] - s[1], s[0], s[2])) for d, v in best.items()}


def test_evidence(spark, sf_dir):
    docs = dict(spanned._docs(spark, sf_dir).collect())
    found = spanned._found(spark, sf_dir).collect()
    wanted = {}
    import re

    sentences = {d: [m.span() for m in re.finditer(spanned.SENTENCES, t)] for d, t in docs.items() if t}
    named = defaultdict(set)
    for r in found:
        for a, b in sentences[r.doc_id]:
            if a <= r.start and r.stop <= b and 6 <= b - a <= 600:
                text = docs[r.doc_id][a:b].lower()
                named[r.doc_id, r.product_key].add((0 if any(w in text for w in spanned.CONCLUSIONS) else 1, a, b))
    for key, parts in named.items():
        own, chars = [], 0
        for _, a, b in sorted(parts):
            if len(own) < 6 and chars + b - a <= 1200:
                own.append((f"E{len(own) + 1}", a, b))
                chars += b - a
        if own:
            wanted[key] = own
    ours = defaultdict(list)
    for r in spanned.t12_mentions(spark, sf_dir).collect():
        ours[r.doc_id, r.product_key].append((r.evidence_id, r.start, r.stop))
    assert {k: sorted(v) for k, v in ours.items()} == wanted


def test_product_signals_and_routing(spark):
    text = "x. The price rose with it. Of no use from here, der fell. Le end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = sp.matches(docs, spanned.ALIASES, spanned.NEGATIVE)
    assert sorted((r.product_key, text[r.start : r.stop]) for r in found.collect()) == [("K.OF", "Of"), ("K.THE", "Le"), ("K.THE", "The"), ("K.THE", "der")]
    parts = sp.sections(docs, spanned.HEADING)
    placed = sp.placed(found, parts)
    at = {w: text.index(w) for w in ("with", "from")}
    signals = spark.createDataFrame([(1, a, a + 4, "看涨", 1.0) for a in at.values()], "doc_id long, start long, stop long, direction string, confidence double")
    ours = {(r.product_key, r.start) for r in sp.product_signals(docs, placed, parts, signals).collect()}
    # each section is owned by one product alone, so its signals are that product's
    assert ours == {("K.THE", at["with"]), ("K.OF", at["from"])}
    related = {(r.product_key, r.n, r.related) for r in sp.related_only(placed).collect()}
    assert related == {("K.THE", 3, False), ("K.OF", 1, False)}
    verdicts = spark.createDataFrame([(1, "K.THE", True, "看涨", 0.4), (1, "K.OF", False, "看跌", 0.9)], "doc_id long, product_key string, accepted boolean, direction string, confidence double")
    quotes = sp.evidence(docs, found, sentence=spanned.SENTENCES)
    routes = {tuple(r) for r in sp.routed(docs, verdicts, quotes, quotes, sp.related_only(placed)).collect()}
    assert routes == {(1, "K.THE", "rule", None, "看涨", 0.4, True), (1, "K.OF", "provisional", "fallback:llm_unavailable", "看跌", 0.9, True), (2, None, "review", "no_product_match", None, None, None), (3, None, "review", "no_product_match", None, None, None)}


def test_routing_against_loops(spark, sf_dir):
    get = lambda df, *c: {(r.doc_id, r.product_key): tuple(r[x] for x in c) for r in df.collect()}
    verdicts, mentions = get(spanned._verdicts(spark, sf_dir), "accepted", "direction", "confidence"), get(sp.related_only(spanned._placed(spark, sf_dir)), "related")
    proven, offered = set(get(spanned.t11(spark, sf_dir))), set(get(spanned.t12(spark, sf_dir)))
    wanted = set()
    for key, (related,) in mentions.items():
        if key not in verdicts:
            wanted.add((*key, "review", "related_product_mention_only" if related else "no_signal", None, None, None))
            continue
        accepted, direction, confidence = verdicts[key]
        if accepted and key in proven:
            wanted.add((*key, "rule", None, direction, confidence, confidence < 0.5))
        else:
            why = "rule_evidence_quality_failed" if accepted else "fallback"
            wanted.add((*key, "provisional", f"{why}:{'llm_unavailable' if key in offered else 'no_product_scoped_context'}", direction, confidence, True))
    for (doc,) in spanned._docs(spark, sf_dir).select("doc_id").collect():
        if doc not in {d for d, _ in mentions}:
            wanted.add((doc, None, "review", "no_product_match", None, None, None))
    assert {tuple(r) for r in spanned.t14(spark, sf_dir).collect()} == wanted and proven


def test_product_signals_against_loops(spark, sf_dir):
    """Each signal in a scope that its product owns alone, or whose nearest owner the product is; then the longest first."""
    area, owner, signals = defaultdict(list), defaultdict(set), []
    placed, parts = spanned._placed(spark, sf_dir), spanned._parts(spark, sf_dir)
    heads = defaultdict(set)
    for r in sp.owners(placed).collect():
        heads[r.doc_id, r.heading_start].add(r.product_key)
    alone = {(r.doc_id, r.body_start): len({k for k in heads[r.doc_id, r.heading_start] if not k.startswith("GROUP.")}) == 1 for r in parts.collect()}
    for r in sp.scopes(placed, parts).collect():
        area[r.doc_id].append((r.product_key, r.start, r.stop, r.owned and alone.get((r.doc_id, r.start), False)))
    for r in sp.owned_signals(spanned._docs(spark, sf_dir), spanned._weighed(spark, sf_dir), spanned._found(spark, sf_dir), spanned.CLAUSE, spanned.SENTENCE).collect():
        signals.append((r.doc_id, r.start, r.stop, r.direction, r.confidence))
        owner[r.doc_id, r.start, r.stop, r.direction].add(r.owner)
    best = defaultdict(dict)
    for doc, start, stop, direction, confidence in signals:
        for key, low, high, own in area[doc]:
            if low <= start and stop <= high and (own or key in owner[doc, start, stop, direction]):
                best[doc, key][start, stop, direction] = max(confidence, best[doc, key].get((start, stop, direction), 0.0))
    ours = defaultdict(list)
    for r in spanned.t7(spark, sf_dir).collect():
        ours[r.doc_id, r.product_key].append((r.start, r.stop, r.direction, r.confidence))
    assert {k: sorted(v) for k, v in ours.items()} == {k: kept([(*x, c) for x, c in v.items()], lambda s: (s[0] - s[1], s[0], s[2])) for k, v in best.items()}


def test_owner_rules(spark):
    docs = spark.createDataFrame([(1, "aa xx bb, yy cc. zz aa")], "doc_id long, text string")
    anchors = spark.createDataFrame([(1, "A", 0, 2), (1, "B", 6, 8), (1, "C", 13, 15), (1, "A", 20, 22)], "doc_id long, product_key string, start long, stop long")
    signals = spark.createDataFrame([(1, 3, 5), (1, 10, 12), (1, 17, 19)], "doc_id long, start long, stop long")
    owners = {r.start: r.owner for r in sp.owned_signals(docs, signals, anchors, spanned.CLAUSE, spanned.SENTENCE).select("start", "owner").collect()}
    assert owners == {3: "A", 10: "C", 17: "A"}


def test_ties_and_negatives(spark):
    docs = spark.createDataFrame([(1, "not the one"), (2, "THE 😀 the0512")], "doc_id long, text string")
    found = sp.matches(docs, spanned.ALIASES, spanned.NEGATIVE).orderBy("doc_id", "start").select("doc_id", "start", "stop").collect()
    assert [tuple(r) for r in found] == [(2, 0, 3), (2, 6, 13)]
    empty = sp.greedy(docs.select("doc_id", F.lit(0).alias("start"), F.lit(1).alias("stop")).limit(0), [F.col("start")], "doc_id")
    assert empty.count() == 0


def sentence_spans(text, low, high, ends=".!?"):
    """(start, stop) of the whole sentences between two places."""
    out, at = [], low
    for i in range(low, high):
        if text[i] in ends or text[i] == "|":
            start = at
            while start < i + 1 and text[start].isspace():
                start += 1
            if text[i] != "|" and start < i + 1:
                out.append((start, i + 1))
            at = i + 1
    return out


def test_candidates_against_loops(spark, sf_dir):
    import re

    from quillstream.operators import proof

    docs = dict(spanned._docs(spark, sf_dir).collect())
    found = defaultdict(list)
    for r in spanned._found(spark, sf_dir).collect():
        found[r.doc_id].append((r.start, r.product_key))
    area = defaultdict(list)
    for r in spanned._area(spark, sf_dir).collect():
        area[r.doc_id, r.product_key].append((r.start, r.stop, r.shared))

    def quote_of(text):
        out = re.sub(r"\b\d+\s*/\s*\d+\b", " ", re.sub(r"(?i)\[PAGE\s+\d+\]", " ", text))
        return re.sub(r"\s+([，。；：！？!?%])", r"\1", re.sub(r"\s+", " ", out).strip()).strip()

    wanted = {}
    for (doc, key), scopes in area.items():
        rows = []
        for low, high, shared in scopes:
            for a, b in sentence_spans(docs[doc], low, high):
                quote = quote_of(docs[doc][a:b])
                keys = {k for s, k in found[doc] if a <= s < b}
                if not 6 <= len(quote) <= 600 or quote[-1] not in ".!?" or quote[0] in "，。；：！？!?%、,." or any(w in quote for w in spanned.BOILER) or re.search(proof.HEADING, quote):
                    continue
                if (keys or shared) and key not in keys:
                    continue
                rows.append((a, b, quote, key in keys, sum(w in quote for w in spanned.CONCLUSIONS)))
        numbered = [(f"E{i + 1}", *r) for i, r in enumerate(sorted(rows))]
        own, used = [], 0
        for e, a, b, quote, named, score in sorted(numbered, key=lambda r: (-r[5], not r[4], r[1])):
            if len(own) < 6 and used + len(quote) <= 1200:
                own.append((len(own), e, a, b, quote))
                used += len(quote)
        if own:
            wanted[doc, key] = own
    ours = defaultdict(list)
    for r in spanned.t12(spark, sf_dir).collect():
        ours[r.doc_id, r.product_key].append((r["rank"], r.evidence_id, r.start, r.stop, r.quote))
    assert {k: sorted(v) for k, v in ours.items()} == wanted


def test_proofs_stay_in_the_products_section(spark):
    from quillstream.operators import proof

    text = "【PX】PX供应增加，价格震荡。短期PX偏弱，跟随成本。【PTA】PTA库存下降，需求改善，预计短期偏强。后市PX下跌，PTA上涨。受PX拖累价格下跌。"
    keys = {"PX": "CZCE.PX", "PTA": "CZCE.TA"}
    import re

    found = [(1, k, m.start(), m.end(), len(text)) for name, k in keys.items() for m in re.finditer(rf"(?<![A-Z]){name}(?![A-Z])", text)]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    matches = spark.createDataFrame(found, "doc_id long, product_key string, start long, stop long, n long")
    cut = text.index("【PTA】")
    area = spark.createDataFrame([(1, "CZCE.PX", 4, cut, False), (1, "CZCE.TA", cut + 5, len(text), False)], "doc_id long, product_key string, start long, stop long, shared boolean")
    signals = [(1, k, m.start(), m.end()) for k, (a, b) in {"CZCE.PX": (4, cut), "CZCE.TA": (cut + 5, len(text))}.items() for m in re.finditer("震荡|偏弱|偏强|上涨|下跌", text) if a <= m.start() < b]
    rows = proof.proofs(docs, matches, area, spark.createDataFrame(signals, "doc_id long, product_key string, start long, stop long")).collect()
    ours = {(r.product_key, r.quote) for r in rows}
    assert ours == {("CZCE.PX", "PX供应增加，价格震荡。"), ("CZCE.PX", "短期PX偏弱，跟随成本。"), ("CZCE.TA", "PTA库存下降，需求改善，预计短期偏强。"), ("CZCE.TA", "后市PX下跌，PTA上涨。")}
    assert all(text[r.start : r.stop] == r.quote for r in rows)


def test_a_negated_signal_loses(spark):
    """What the context leaves of a signal counts in the vote."""
    from quillstream.functions import phrases as ph
    from quillstream.operators.text import arbitrated

    text = "铜价尚未上涨，另一方面各地的库存增加"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    at = {w: text.index(w) for w in ("上涨", "库存增加")}
    rows = [(1, at["上涨"], at["上涨"] + 2, "看涨", 1.0), (1, at["库存增加"], at["库存增加"] + 4, "看跌", 0.75)]
    signals = sp.with_context(docs, spark.createDataFrame(rows, "doc_id long, start long, stop long, direction string, confidence double"), ph.CONTEXT, ph.RISKS)
    weighed = signals.select("doc_id", "start", "stop", "direction", F.col("sure").alias("confidence"), F.col("confidence").alias("weight"), "factor")
    assert {(r.direction, r.confidence, r.factor) for r in weighed.collect()} == {("看涨", 0.35, 0.25), ("看跌", 1.0, 1.0)}
    found = sp.matches(docs, {"铜": "SHFE.CU"})
    parts = sp.sections(docs, "【[^】]+】")
    kept = sp.product_signals(docs, sp.placed(found, parts), parts, weighed)
    votes = kept.select(F.col("doc_id").alias("article_id"), "product_key", "direction", "weight", "confidence", "factor")
    assert [(r.direction, r.accepted) for r in arbitrated(votes).collect()] == [("看跌", True)]
