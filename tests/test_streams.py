"""Camera files and their sidecars as streams over real files."""

import json
import os
import random

import numpy as np

from kinelake.operators.filters import one_euro
from kinelake.sources import streams as S
from kinelake.streaming import operators as O


def test_sidecars_may_come_before_after_or_never(spark, tmp_path):
    files, sides = tmp_path / "files", tmp_path / "sides"
    files.mkdir(), sides.mkdir()
    now = [1_700_000_000]

    def put(folder, name, content):
        path = folder / name
        path.write_bytes(content)
        os.utime(path, (now[0], now[0]))

    def side(n, **more):
        body = {"file": f"f{n}.jpg", "camera": "front", "run_id": "r", "sequence": n, "captured_at_ns": n * 10, **more}
        put(sides, f"f{n}.json", json.dumps(body).encode())

    def run():
        stream = S.camera_stream(spark, str(files), str(sides), "10 minutes")
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return {r.path.rsplit("/", 1)[-1] if r.path else f"no file {r.sequence}": r for r in rows}

    put(files, "f1.jpg", b"jpeg"), put(files, "f2.jpg", b""), put(files, "f3.jpg", b"jpeg"), put(files, "note.txt", b"x")
    side(1, fx="2.5")
    side(4)
    found = run()
    assert set(found) == {"f1.jpg"} and found["f1.jpg"].calibration == {"fx": "2.5"} and found["f1.jpg"].described
    # The sidecar of the second file and the file of the fourth sidecar come five minutes later.
    now[0] += 300
    side(2)
    put(files, "f4.jpg", b"jpeg")
    found = run()
    assert set(found) == {"f1.jpg", "f4.jpg"} and found["f4.jpg"].captured_at_ns == 40 and not found["f4.jpg"].empty
    # Two hours later nothing describes the third file any more, and the second has no bytes, so no reader has seen it.
    now[0] += 7200
    put(files, "f9.jpg", b"jpeg")
    side(9)
    found = run()
    assert set(found) == {"f1.jpg", "f3.jpg", "f4.jpg", "f9.jpg", "no file 2"}
    assert found["no file 2"].empty and found["no file 2"].captured_at_ns == 20 and found["no file 2"].run_id == "r"
    assert not found["f3.jpg"].described and found["f3.jpg"].captured_at_ns == 0 and found["f3.jpg"].run_id is None


def test_joints_of_a_run_are_smoothed_in_one_group(spark, tmp_path):
    """Joints that come and go across micro-batches, rows out of order; grouping by run alone moves each run's rows once."""
    rng = random.Random(4)
    rows = [(run, (t + 1) * 10**9, t, {j: rng.random() for j in "abc" if rng.random() < 0.7}) for run in (1, 2) for t in range(60)]
    schema = "run_id long, captured_at_ns long, sequence long, action map<string,double>"
    for part in range(3):
        cut = [r for r in rows if r[2] // 20 == part]
        spark.createDataFrame(rng.sample(cut, len(cut)), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    smooth = O.one_euro_stream(source)
    top = smooth._jdf.queryExecution().analyzed()
    assert top.groupingAttributes().length() == 1
    writer = smooth.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = {(r.run_id, r.joint, r.sequence): r.smoothed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(found) == sum(len(r[3]) for r in rows)
    for run in (1, 2):
        for joint in "abc":
            values = [(r[2], r[3][joint]) for r in rows if r[0] == run and joint in r[3]]
            alone = one_euro(np.array([[v] for _, v in values]), 1.0, 30.0)[:, 0]
            np.testing.assert_allclose([found[run, joint, t] for t, _ in values], alone, rtol=1e-12)
