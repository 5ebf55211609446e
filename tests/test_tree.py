"""Listing and reading of files by tasks: every name, against os.walk."""

import os

import pytest

from glintmark.sources import files as S
from glintmark.sources import tree


def test_every_file_below_a_folder(spark, tmp_path, monkeypatch):
    names = ["a.py", ".env", ".github/workflows/x.yml", "_conf/_x.ini", "d/e/f/g.txt", "d/ü b%20c#?.txt", "d/e/empty", "skip/x.py", "d/skip/y.py", *[f"many/{k}/f{k}" for k in range(40)]]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"" if n.endswith("empty") else n.encode() * 3)
    os.symlink(tmp_path, tmp_path / "d/loop")
    want = {os.path.join(at, f): open(os.path.join(at, f), "rb").read() for at, _, fs in os.walk(tmp_path) for f in fs}
    for enough in (1, 5, 256):
        monkeypatch.setattr(tree, "ENOUGH", enough)
        rows = S.files(spark, str(tmp_path)).collect()
        assert len(rows) == len(want) == len(names) and {r.path.removeprefix("file:"): bytes(r.content) for r in rows} == want
        assert all(r.length == len(r.content) and abs(r.modified.timestamp() - os.stat(r.path[5:]).st_mtime) < 1e-3 for r in rows)
    some = {r.path.rsplit("/", 1)[1] for r in S.files(spark, [str(tmp_path / "d"), str(tmp_path / ".env"), f"file:{tmp_path}/skip"], exclude=["/d/skip"]).select("path").collect()}
    assert some == {"g.txt", "ü b%20c#?.txt", "empty", ".env", "x.py"}
    assert S.files(spark, str(tmp_path), include=["nowhere"]).count() == 0
    with pytest.raises(FileNotFoundError):
        S.files(spark, str(tmp_path / "none"))


def test_files_that_go_and_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "BATCH", 10)
    monkeypatch.setattr(tree, "SHARE", 50)
    for k in range(30):
        (tmp_path / f"f{k}").write_bytes(bytes([k]) * k)
    listed = tree.listing(spark, str(tmp_path)).cache()
    assert listed.count() == 30 and tree.total(listed) == 435
    (tmp_path / "f7").unlink()
    got = tree.contents(listed, 435)
    assert got.rdd.getNumPartitions() == 9
    assert {r.path.rsplit("/f", 1)[1]: bytes(r.content) for r in got.collect()} == {str(k): bytes([k]) * k for k in range(30) if k != 7}
