"""Names out of tables, found in texts by one Aho-Corasick automaton, however many there are.

A lexicon's rows go to the tasks once; each text is read once for all names. What may stand round a name follows
from its kind: a Latin name is a word of its own that may carry a contract's digits, a single Latin letter has to carry them, any
other name (Chinese ones, say) stands wherever its characters do. Case does not count.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.phrases import alias_key
from quillstream.operators.tables import sliced

#: Rows of a lexicon: it is sent to the tasks whole, so a larger one is refused.
MOST_NAMES = 500_000
#: Characters before a match in which a product's negative words count.
REACH = 20

_LATIN = re.compile("[A-Za-z0-9]+")
#: What may follow a name, by kind: a lone letter, a Latin word, a Latin anchor of a text, any other name.
LETTER, WORD, ANCHOR, PLAIN = range(4)
_TAILS = (re.compile(r"\d{3,4}(?![A-Za-z0-9])"), re.compile(r"(?:\d{2,4})?(?![A-Za-z0-9])"), re.compile(r"(?=\d{2,4}\s*合约|[^A-Za-z0-9]|\Z)"), re.compile(""))


def kind_of(name: str) -> int:
    return PLAIN if not _LATIN.fullmatch(name) else LETTER if len(name) == 1 else WORD


def anchor_kind(name: str) -> int:
    """An anchor of Latin letters, digits and blanks stands apart from others; a contract's digits may follow it."""
    return ANCHOR if name and all(c.isascii() and (c.isalnum() or c.isspace()) for c in name) else PLAIN


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) and "Σ" not in text else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Finder:
    """All places of some names (name, kind) in a text; places of one name do not overlap."""

    def __init__(self, names: Iterable[tuple[str, int]]) -> None:
        import ahocorasick

        self.names = list(names)
        by_form: dict[str, list[int]] = {}
        for i, (name, _) in enumerate(self.names):
            if name:
                by_form.setdefault(folded(name), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for form, which in by_form.items():
            self.automaton.add_word(form, (len(form), which))
        if by_form:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, stop, number of the name), by where the name itself ends."""
        if not len(self.automaton) or not text:
            return
        last: dict[int, int] = {}
        for end, (size, which) in self.automaton.iter(folded(text)):
            start = end + 1 - size
            for i in which:
                kind = self.names[i][1]
                if start < last.get(i, 0) or (kind != PLAIN and start and _LATIN.match(text, start - 1, start)):
                    continue
                tail = _TAILS[kind].match(text, end + 1)
                if tail:
                    last[i] = tail.end()
                    yield start, tail.end(), i


class Lexicon:
    """Rows (name, product_key, display_name, source, negative words) as a matcher of texts and titles."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = [(name.strip(), key, shown, source, tuple(w.casefold() for w in barred if w)) for name, key, shown, source, barred in rows if name.strip()]
        self.finder = Finder((name, kind_of(name)) for name, *_ in self.rows)

    def matches(self, text: str, title: str = "") -> list[tuple]:
        """(start, stop, row, evidence): the longest of those that begin first, without negative words before; then what a title names, where that does not overlap."""
        found = []
        for start, stop, i in self.finder.find(text):
            barred = self.rows[i][4]
            if barred and any(w in before for before in [text[max(0, start - REACH) : start].casefold()] for w in barred):
                continue
            found.append((start, start - stop, self.rows[i][1], text[start:stop].casefold(), i))
        out: list[tuple] = []
        for start, less, _, _, i in sorted(found):
            if not out or start >= out[-1][1]:
                out.append((start, start - less, i, "body_alias"))
        if title:
            body, taken = [(a, b) for a, b, *_ in out], []
            first: dict[int, tuple[int, int]] = {}
            for start, stop, i in self.finder.find(title):
                first.setdefault(i, (start, stop))
            for i in sorted(first, key=lambda i: (len(self.rows[i][0]), self.rows[i][0].casefold(), self.rows[i][1]), reverse=True):
                start, stop = first[i]
                near = bisect_right(body, (stop - 1, 1 << 62)) - 1  # body spans lie apart and in order
                if not (near >= 0 and body[near][1] > start) and not any(start < b and a < stop for a, b in taken):
                    taken.append((start, stop))
                    out.append((start, stop, i, "title_alias"))
        return sorted(out, key=lambda m: (m[0], m[0] - m[1]))


def lexicon_rows(entries: DataFrame, dynamic: DataFrame | None = None) -> DataFrame:
    """name, product_key, display_name, source, negatives of entries (product_key, display_name, aliases, negatives) and of reviewed aliases (alias, product_key) beside them.

    A name that is nothing but brackets and blanks is none."""
    rows = entries.select(F.explode("aliases").alias("name"), "product_key", F.coalesce("display_name", "product_key").alias("display_name"), F.lit("lexicon").alias("source"), F.coalesce("negatives", F.array().cast("array<string>")).alias("negatives"))
    if dynamic is not None:
        known = entries.groupBy("product_key").agg(F.min("display_name").alias("display_name"), F.flatten(F.collect_list("negatives")).alias("negatives"))
        more = dynamic.select(F.col("alias").alias("name"), "product_key").join(known, "product_key", "left")
        rows = rows.unionByName(more.select("name", "product_key", F.coalesce("display_name", "product_key").alias("display_name"), F.lit("approved_review").alias("source"), F.coalesce("negatives", F.array().cast("array<string>")).alias("negatives")))
    return rows.filter((F.coalesce("product_key", F.lit("")) != "") & (alias_key("name") != ""))


def gathered(rows: DataFrame) -> list[tuple]:
    """A lexicon's rows, of which there are MOST_NAMES at most."""
    held = rows.select("name", "product_key", "display_name", "source", "negatives").limit(MOST_NAMES + 1).collect()
    if len(held) > MOST_NAMES:
        raise ValueError(f"a lexicon of more than {MOST_NAMES} names")
    return sorted(tuple(r) for r in held)


def find(docs: DataFrame, rows: list[tuple], title: str | None = None) -> DataFrame:
    """doc_id, product_key, display_name, alias (as written), start, stop, n (the text's length), source, evidence of each match. A null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, product_key string, display_name string, alias string, start long, stop long, n long, source string, evidence string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in sliced(batches):
            at, out = [], []
            for row, (text, name) in enumerate(zip(batch["text"].to_pylist(), batch["title"].to_pylist(), strict=True)):
                for start, stop, i, evidence in lexicon.matches(text or "", name or ""):
                    _, key, shown, source, _ = lexicon.rows[i]
                    at.append(row)
                    out.append((key, shown, ((text if evidence == "body_alias" else name) or "")[start:stop], start, stop, len(text or ""), source, evidence))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), *columns], names=["doc_id", "product_key", "display_name", "alias", "start", "stop", "n", "source", "evidence"])

    titled: Column = F.lit("") if title is None else F.col(title)
    return docs.select("doc_id", "text", titled.alias("title")).mapInArrow(run, schema)


def table_matches(docs: DataFrame, entries: DataFrame, dynamic: DataFrame | None = None, title: str | None = None) -> DataFrame:
    """Matches of a lexicon in tables: aliases by product with negative words, and reviewed aliases."""
    return find(docs, gathered(lexicon_rows(entries, dynamic)), title)
