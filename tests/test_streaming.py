"""Streams of more files than one batch takes."""

import os
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq

from quillstream.plans import registry


def test_running_trend_over_files_in_any_order(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    start, want = datetime(2024, 1, 1), {}
    for i in range(45):
        days = [(i * 17 + j * 13) % 60 for j in range(4)]
        for d in days:
            want.setdefault(str((start + timedelta(d)).date()), []).append(float(i + d))
        path = tmp_path / "events.parquet" / f"part-{i:02}.parquet"
        times = pa.array([start + timedelta(d, hours=i % 24) for d in days], pa.timestamp("us", "UTC"))
        pq.write_table(pa.table({"ts": times, "value": [float(i + d) for d in days]}), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    got = {r["day"]: (r["value"], r["n"]) for r in registry.queries()["r4_running_trend"](spark, str(tmp_path)).collect()}
    assert got == {d: (round(sum(v) / len(v), 4), len(v)) for d, v in want.items()}
