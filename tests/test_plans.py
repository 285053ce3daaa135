"""Plans of queries that once carried whole texts with each occurrence, or computed a feature wherever it is named."""

import re

import __spark_entry__


def plan(spark, sf_dir, name):
    return __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_no_text_goes_on_with_each_occurrence(spark, sf_dir):
    lines = plan(spark, sf_dir, "l1_occurrences").splitlines()
    fed = [below for line, below in zip(lines, lines[1:]) if "ArrowEvalPython" in line]
    assert fed and not [x for x in fed if re.search(r"\btext#", x)]


def test_features_of_lines_are_computed_once(spark, sf_dir):
    assert plan(spark, sf_dir, "c6_table_lines").lower().count("regexp") < 20


def test_no_window_frame_shrinks_from_row_to_row(spark, sf_dir):
    """Such a frame is read anew for each row: its work grows with the square of a document's length."""
    for name in ("j8_signal_owners", "t12_evidence"):
        assert not re.search(r"RowFrame, (?:currentrow\$\(\)|\d+), unboundedfollowing", plan(spark, sf_dir, name))


def test_shown_texts_and_names_are_computed_once(spark, sf_dir):
    for name, most in (("c13_displayed_text", 40), ("g3_segments", 1200)):
        assert plan(spark, sf_dir, name).lower().count("regexp") < most, name


def test_batches_are_cut_and_nothing_is_lost():
    import pyarrow as pa

    from quillstream.operators.tables import sliced

    batches = [pa.record_batch({"x": list(range(n))}) for n in (0, 1, 1200)]
    cut = list(sliced(iter(batches), 500))
    assert max(b.num_rows for b in cut) <= 500 and [x for b in cut for x in b["x"].to_pylist()] == [0, *range(1200)]
