"""Incremental scans: the same findings as a scan of everything, read and scanned as little as possible."""

import io
import os
import zipfile
from dataclasses import replace

from pyspark.sql import functions as F

from glintmark.operators import rescan
from glintmark.plans import engine
from glintmark.sources import files as S

LONG_AGO = 1_600_000_000
CONFIG = engine.ScanConfig(entropy=False, technology=False, structural=False, items=False, entries=False, use_context=False, use_scores=False)


def put(folder, name, body, at=LONG_AGO):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body if isinstance(body, bytes) else body.encode())
    os.utime(path, (at, at))


def secret(k):
    return f'# settings\napi_token = "tok{k:04}AbCdEfGh{k * 7919:08}"\n'


def packed(k):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("in/app.py", secret(k))
    return out.getvalue()


def shown(df):
    return sorted((r.path.split("/in/", 1)[1], r.line, r.value, r.rule_id) for r in df.select("path", "line", "value", "rule_id").collect())


def whole(spark, at, config=CONFIG):
    got = shown(engine.scan_binary(spark, S.files(spark, str(at)), config))
    engine.release(spark)
    return got


def test_runs_agree_with_whole_scans(spark, tmp_path):
    at, state = tmp_path / "in", str(tmp_path / "state")
    for k in range(6):
        put(at, f"d/f{k}.py" if k else ".env/f0.py", secret(k))
    put(at, "d/a b%20ü#?.py", secret(20))
    put(at, "d/x.zip!y.py", secret(21))  # a plain file, though it looks like an archive's member
    put(at, "p.zip", packed(30))
    put(at, "clean.py", "x = 1\n")
    assert rescan.update(spark, str(at), state, CONFIG) == {"added": 10, "same": 0, "touched": 0, "changed": 0, "deleted": 0}
    first = shown(rescan.findings(spark, state))
    assert first == whole(spark, at) and len({p for p, *_ in first}) == 9

    put(at, ".env/f0.py", secret(100), LONG_AGO + 5)  # changed
    put(at, "d/f1.py", secret(1), LONG_AGO + 5)  # touched
    put(at, "clean.py", secret(50), LONG_AGO + 5)
    put(at, "p.zip", packed(31), LONG_AGO + 5)
    put(at, "new.py", secret(60))
    (at / "d/f2.py").unlink()
    assert rescan.update(spark, str(at), state, CONFIG) == {"added": 1, "same": 5, "touched": 1, "changed": 3, "deleted": 1}
    assert shown(rescan.findings(spark, state)) == whole(spark, at)
    scanned = spark.read.parquet(f"{state}/findings/run=2").select("file").distinct().count()
    read = spark.read.parquet(f"{state}/states/run=2").where("state in ('added', 'doubtful')").count()
    assert (read, scanned) == (5, 4)

    assert rescan.update(spark, str(at), state, CONFIG) == {"added": 0, "same": 10, "touched": 0, "changed": 0, "deleted": 0}
    assert not os.path.exists(f"{state}/findings/run=3") and shown(rescan.findings(spark, state)) == whole(spark, at)

    rescan.compact(spark, state)
    assert os.listdir(f"{state}/findings") == ["run=4"] and shown(rescan.findings(spark, state)) == whole(spark, at)
    put(at, "d/f3.py", "nothing = 1\n", LONG_AGO + 9)
    assert rescan.update(spark, str(at), state, CONFIG)["changed"] == 1
    assert shown(rescan.findings(spark, state)) == whole(spark, at)


def test_other_settings_lost_runs_and_fresh_files(spark, tmp_path):
    at, state = tmp_path / "in", str(tmp_path / "state")
    put(at, "a.py", secret(1))
    put(at, "b.py", secret(2))
    rescan.update(spark, str(at), state, CONFIG)
    # A run that was lost before its manifest was written: its number is used again.
    put(at, "a.py", secret(3), LONG_AGO + 1)
    rescan.findings(spark, state).withColumn("value", F.lit("from a lost run")).write.parquet(f"{state}/findings/run=2")
    os.makedirs(f"{state}/manifest/run=2/_temporary")
    assert rescan.runs(state) == [1]
    assert rescan.update(spark, str(at), state, CONFIG)["changed"] == 1
    assert shown(rescan.findings(spark, state)) == whole(spark, at)
    # Other settings: nothing is reused.
    more = replace(CONFIG, exclude=["b.py"])
    assert rescan.update(spark, str(at), state, more)["added"] == 1
    assert {p for p, *_ in shown(rescan.findings(spark, state))} == {"a.py"}
    # A file changed in the moment of the listing, later again within the same time and length, is still seen.
    now = rescan.dt.datetime.now().timestamp() + 1
    put(at, "a.py", secret(4), now)
    rescan.update(spark, str(at), state, more)
    put(at, "a.py", secret(5), now)
    assert rescan.update(spark, str(at), state, more)["changed"] == 1
    assert "tok0005AbCdEfGh00039595" in {v for _, _, v, _ in shown(rescan.findings(spark, state))}


def test_nothing_there(spark, tmp_path):
    at, state = tmp_path / "in", str(tmp_path / "state")
    assert rescan.runs(state) == [] and rescan.findings(spark, state) is None
    put(at, "a.py", secret(1))
    rescan.update(spark, str(at), state, CONFIG)
    (at / "a.py").unlink()
    put(at, "empty.py", "")
    assert rescan.update(spark, str(at), state, CONFIG) == {"added": 1, "same": 0, "touched": 0, "changed": 0, "deleted": 1}
    assert rescan.findings(spark, state).count() == 0
