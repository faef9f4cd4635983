import os
import tempfile

from tabulon.plans.fixtures import DEMO_ROWS, DEMO_SCHEMA
from tabulon.streaming.uploads import watch_uploads


def test_each_upload_is_a_batch(spark):
    src = tempfile.mkdtemp(prefix="tabulon-up-")
    out = tempfile.mkdtemp(prefix="tabulon-res-")
    header = ",".join(f.name for f in DEMO_SCHEMA.fields)
    for k, rows in enumerate([DEMO_ROWS[:8], DEMO_ROWS[8:]]):
        with open(os.path.join(src, f"upload{k}.csv"), "w") as fh:
            fh.write(header + "\n" + "\n".join(",".join(map(str, r)) for r in rows) + "\n")
    q = watch_uploads(spark, src, out, DEMO_SCHEMA)
    q.awaitTermination(300)
    batches = sorted(d for d in os.listdir(out) if d.startswith("batch="))
    assert batches == ["batch=0", "batch=1"]
    total = sum(spark.read.parquet(os.path.join(out, b, "cleaned")).count() for b in batches)
    assert total == 16
    kpi = {r["kpi"]: r["value"] for r in spark.read.parquet(os.path.join(out, "batch=0", "kpis")).collect()}
    assert kpi["Total Records"] == 8
    assert os.path.isdir(os.path.join(out, "batch=1", "pack", "revenue_by_cat"))
