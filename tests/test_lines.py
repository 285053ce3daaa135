"""Lines' features: read without patterns where none is needed, equal to loops over odd lines."""

import re

import __spark_entry__
from pyspark.sql import functions as F

from quillstream.functions.columns import BLANKS, stripped
from quillstream.operators import cleaning as cl
from quillstream.packs import DRIVER, ZH

ODD = ["", " ", "\u3000a b\u2003", "\x1ca\x85", "a\xa0b\u1680", "库存 上涨", "WEE", "x第3页", "第3页", "https://a b", "https://a", " === ", "a ===", "12/3", "400-123-4567", "é\t12-3 4.5/6", "\u2028", "\u200b a", "版权所有 x", "with this", "copyright", "1234,5678 观点"]


def plan(spark, sf_dir, name):
    return __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_ends_of_lines_are_found_without_a_pattern(spark, sf_dir):
    """A pattern for blanks at a line's end is tried at each of its places."""
    for name in ("c7_semantic_lines", "c7_image_lines", "c9_noise_tests", "c12_clean_outcome", "c5_structured_text"):
        assert "^[\n" not in plan(spark, sf_dir, name).replace("\\n", "\n"), name


def test_odd_lines_as_by_loops(spark):
    java = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), BLANKS)
    blank, outer = re.compile(f"[\n{java}]+"), re.compile(rf"^[\n{java}]+|[\n{java}]+\Z")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, line string")
    for pack in (ZH, DRIVER):
        out = rows.select("line", stripped("line").alias("s"), cl.bare(F.col("line")).alias("b"), cl.has(F.col("line"), pack.hints).alias("h"), cl.noise_line(F.col("line"), pack).alias("n"), cl.count_of(F.col("line"), pack.letters[1:-1]).alias("c"))
        for r in out.collect():
            s = outer.sub("", r.line)
            noisy = bool(s) and (any(re.search(p, s) for p in pack.noise_patterns) or any(w.lower() in s.lower() for w in pack.noise_words))
            assert (r.s, r.b, r.h, r.n, r.c) == (s, blank.sub("", r.line), any(w in r.line for w in pack.hints), noisy, len(re.findall(pack.letters, r.line))), (pack.letters, r.line)


class Cut:
    """A table that gives back the function its batches go through."""

    def __init__(self, **kinds):
        from pyspark.sql.types import StructType

        self.schema = StructType.fromDDL(", ".join(f"{k} {v}" for k, v in kinds.items()))

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_few_texts_are_held_at_a_time(spark):
    """What a task makes of a batch in Python is made for some of its rows at a time, and nothing is lost."""
    import pyarrow as pa

    from quillstream.operators import files

    ids = list(range(1200))
    out = list(files.decoded(Cut(doc_id="long"), "doc_id")(iter([pa.record_batch({"doc_id": ids, "content": [b"# t%d" % i for i in ids]})])))
    assert max(b.num_rows for b in out) <= 512 and [x for b in out for x in b["title"].to_pylist()] == [f"t{i}" for i in ids]


def test_few_texts_are_cut_at_a_time(spark):
    import pyarrow as pa

    from quillstream.operators import replies

    ids = list(range(1200))
    long = "a。" * 700 + " " * 900 + "b，" * 800 + "c" * 4000
    out = list(replies.chunks(Cut(doc_id="long"))(iter([pa.record_batch({"doc_id": ids, "blocks": [[f"x{i}"] for i in ids]}), pa.record_batch({"doc_id": [7], "blocks": [[long]]})])))
    assert max(b.num_rows for b in out[:-1]) <= 512 and [x for b in out[:-1] for x in b["chunk"].to_pylist()] == [f"x{i}" for i in ids]
    last = out[-1]["chunk"].to_pylist()
    assert max(map(len, last)) <= 1500 and "".join("".join(last).split()) == "".join(long.split())


def test_names_are_tried_where_one_may_begin():
    """Each name brings a look behind: without this all of them were tried at each place of a text."""
    from quillstream.operators.segmenting import Names

    names = Names({"The": "K1", "库存": "K2", "a-b": "K3", "]x": "K4"}, {"rb": "K5"}, {"the": ("in ",)})
    assert names.pattern.startswith("(?i)(?-i:(?=[")
    old = names.pattern.replace(re.match(r"\(\?i\)(\(\?-i:\(\?=\[.*?\]\)\))\(\?:", names.pattern)[1], "", 1)
    for text in ("The in the a-b 库存rb2505]x", "RB25 rb 005 THE-the A-B", "", "in The\n]X 库 存"):
        found = lambda p: [m.span() for m in re.finditer(p, text)]
        assert found(names.pattern) == found(old)


def test_classes_of_characters_are_tables(spark, sf_dir):
    """Each range in a class was asked for every character of a line."""
    for name in ("c9_noise_tests", "c7_image_lines"):
        text = plan(spark, sf_dir, name)
        assert "[^A-Za-z]+" not in text and "[A-Za-z0-9À" not in text and r"\x0B-\r" not in text, name
    signs = spark.createDataFrame([("a" + chr(i) + "b" + chr(i),) for i in range(1, 0x320) if chr(i) not in "ab"], "x string")
    for letters in ("A-Za-z", "0-9", "À-ɏ", "一-鿿", "A-Za-z0-9À-ɏ"):
        table = F.regexp_replace("x", f"[^{cl.spelled(letters)}]", "") == F.regexp_replace("x", f"[^{letters}]", "")
        assert signs.filter(~table).count() == 0, letters


def test_dates_are_looked_for_where_digits_stand(spark, sf_dir):
    text = plan(spark, sf_dir, "c9_noise_tests")
    assert "THEN (size(regexp_extract_all(x" in text.split(r"\d{4}[-/.]")[0][-200:]


def test_misreadings_are_looked_for_beyond_ascii(spark, sf_dir):
    rows = spark.createDataFrame([("The  x 年未 上且",), ("é 装直",), ("plain  text",), (None,)], "x string")
    assert [r[0] for r in rows.select(cl.repaired(F.col("x"), ZH)).collect()] == ["The x 年末且", "é 装置", "plain text", None]
    assert "CASE WHEN (octet_length(lambda" in plan(spark, sf_dir, "c7_image_lines").split("年未")[0][-700:]


def test_shown_lines_as_by_patterns(spark, sf_dir):
    """Ends of lines were patterns tried at each place of a text, and a text was shown whether or not it had to be."""
    import random

    text = plan(spark, sf_dir, "p6_refined_problems")
    assert "(?md)^[" not in text
    blank = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: chr(int(m[1], 16)), BLANKS)
    steps = [(rf"(?m)^[{blank}]+|[{blank}]+$", ""), (rf"\b[0-9]+[{blank}]*/[{blank}]*[0-9]+\b", " "), (r"[ \t]+", " "), (rf"[{blank}]+([，。；：！？、】）)])", r"\1"), (rf"([【（(])[{blank}]+", r"\1"), (rf"(?m)^[{cl.ENDS}]+|[{cl.ENDS}]+$", ""), (rf"(?m){cl.ORPHANS}", ""), (rf"(?m)^[{blank}]+|[{blank}]+$", "")]

    def slow(x):
        for pattern, to in steps:
            x = re.sub(pattern, to, x)
        return x

    rnd, signs = random.Random(7), [" ", "  ", "\t", "\n", "\u3000", "，", "。", "；", ":", "：", "(", "【", "）", ")", "】", "电话", "邮箱", "12/3", " 4 / 5 ", "a", "é", "x y", "\x85", "\u2028", "\x1c", "?", "！"]
    texts = ["", " ", "\n", *("".join(rnd.choice(signs) for _ in range(rnd.randrange(25))) for _ in range(600))]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", cl.shown_lines(F.col("x")).alias("s"))
    for r in rows.collect():
        assert r.s == slow(r.x), repr(r.x)


def test_contacts_signs(spark):
    from quillstream.functions import phrases as ph

    texts = {"从 业资格\n证号": True, "免责 声明": True, "证号 123": False, "tel 电话：021-12345678": True, "WWW.a.b": True, "Www": False, "a@b.cc": True, "a@b": False, "plain": False, "http://x": True, "热线 12": False}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ph.has_contacts("t").alias("c")).collect()
    assert {r.t: r.c for r in got} == texts
