"""Archives and databases: splits, parts, damage, nesting; nothing is lost without a row."""

import bz2
import gzip
import io
import lzma
import random
import sqlite3
import tarfile
import tracemalloc
import zipfile

import pytest

from glintmark.plans import engine
from glintmark.sources import archives, files, parsers


def zipped(members, kind=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", kind) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def tarred(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, body in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def walked(path, data, **more):
    return list(archives.walk(path, path, io.BytesIO(data), **more))


def text(k):
    rnd = random.Random(k)
    return "".join(rnd.choice("abc é\n") for _ in range(rnd.randrange(300))).encode()


@pytest.mark.parametrize("name, pack", [("a.zip", zipped), ("a.tar", tarred), ("a.tar.gz", lambda m: tarred(m, "w:gz")), ("a.tar.bz2", lambda m: tarred(m, "w:bz2")), ("a.tar.xz", lambda m: tarred(m, "w:xz")), ("a.txz", lambda m: tarred(m, "w:xz"))])
@pytest.mark.parametrize("part", [float("inf"), 7, 64])
def test_members_and_parts(name, pack, part):
    members = {f"d/{k}.txt": text(k) for k in range(30)} | {"empty.txt": b"", "bad.bin": b"\xff\xfe\n\xe9x"}
    rows = walked(name, pack(members), part_bytes=part)
    assert {r.status for r in rows} == {"ok"}
    for m, body in members.items():
        own = [r for r in rows if r.path == f"{name}!{m}"]
        want = body.decode("utf-8", "replace")
        assert [r.part for r in own] == list(range(len(own))) and own[0].whole == (len(own) == 1)
        lines = {}
        for r in own:
            for k, line in enumerate(r.content.split("\n")):
                lines[r.first_line + k] = lines.get(r.first_line + k, "") + line
        assert [lines[k] for k in sorted(lines)] == want.split("\n") and sorted(lines) == list(range(1, len(lines) + 1))


def test_one_damaged_member_and_a_locked_one():
    members = {f"{k}.txt": bytes(f"token {k} ", "ascii") * 50 for k in range(20)}
    data = bytearray(zipped(members))
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        at = z.getinfo("7.txt").header_offset
        lock = z.start_dir + sum(46 + len(i.filename) + len(i.extra) + len(i.comment) for i in z.infolist()[:3]) + 8
    data[at + 45 : at + 50] = b"\xff" * 5
    data[lock] |= 1
    rows = walked("a.zip", bytes(data))
    bad = {r.path: (r.status, r.reason) for r in rows if r.status != "ok"}
    assert set(bad) == {"a.zip!7.txt", "a.zip!3.txt"} and all(s == "failed" for s, _ in bad.values()) and "password" in bad["a.zip!3.txt"][1]
    assert {r.path for r in rows if r.status == "ok" and r.whole} >= {f"a.zip!{k}.txt" for k in range(20) if k not in (3, 7)}


def test_damage_in_streams():
    members = {f"{k}.txt": text(k) * 20 for k in range(20)}
    whole = tarred(members)
    for cut in (100, 700, len(whole) // 2, len(whole) - tarfile.RECORDSIZE + 512):
        rows = walked("a.tar", whole[:cut])
        assert rows[-1].status == "failed" and sum(r.status == "failed" for r in rows) in (1, 2) and (cut < 1000 or rows[0].status == "ok"), cut
    header = bytearray(whole)
    with tarfile.open(fileobj=io.BytesIO(whole)) as t:
        offset = t.getmembers()[5].offset
    header[offset : offset + 200] = b"\xff" * 200
    rows = walked("a.tar", bytes(header))
    assert [r.status for r in rows] == ["ok"] * 5 + ["failed"] and "rest" in rows[-1].reason
    squeezed = gzip.compress(b"line\n" * 100_000)
    rows = walked("n.log.gz", squeezed[: len(squeezed) // 2], part_bytes=1000)
    assert rows[0].path == "n.log.gz!n.log" and rows[-1].status == "failed"
    for bad in ("x.zip", "x.tar", "x.gz", "x.bz2", "x.xz", "x.tgz"):
        assert [r.status for r in walked(bad, b"not an archive at all")] == ["failed"], bad
    assert [r.content for r in walked("b.bz2", bz2.compress(b"x\ny"))] == [r.content for r in walked("b.xz", lzma.compress(b"x\ny"))] == ["x\ny"]


def test_nesting_names_and_limits():
    data = b"deep secret"
    name = "f.txt"
    for k in range(7):
        data, name = (zipped({name: data}), f"{k}.zip") if k % 2 else (tarred({name: data}, "w:gz"), f"{k}.tgz")
    rows = walked(name, data)
    assert [(r.status, r.reason) for r in rows] == [("skipped", "nested too deep")]
    rows = walked(name, data, depth=9)
    assert [(r.status, r.content) for r in rows] == [("ok", "deep secret")] and rows[0].path.count("!") == 7 and rows[0].archive_path == name
    assert [r.status for r in walked("e.zip", zipped({"../x": b"1", "C:\\y": b"2", "/z": b"3", "ok": b"4"}))] == ["skipped"] * 3 + ["ok"]
    rows = walked("m.zip", zipped({"a": b"x" * 10, "b": b"x" * 100, "c": b"x"}), limits=archives.Limits(bytes=20))
    assert [r.status for r in rows] == ["ok", "skipped", "ok"]
    bomb = walked("z.gz", gzip.compress(b"0" * 5_000_000), limits=archives.Limits(bytes=10_000), part_bytes=1000)
    assert bomb[-1].status == "skipped" and sum(len(r.content or "") for r in bomb) < 10_000


def test_a_huge_member_stays_in_little_memory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("big.log", "w") as f:
        for _ in range(60):
            f.write(b"a line of some words\n" * 20_000)
    for name, data in (("big.zip", out.getvalue()), ("outer.tgz", tarred({"big.zip": out.getvalue()}, "w:gz"))):
        tracemalloc.start()
        lines = sum(r.content.count("\n") + 1 for r in archives.walk(name, name, io.BytesIO(data), part_bytes=1 << 18) if r.content)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert lines == 1_200_001 and peak < 6 << 20, (lines, peak)  # of 25 MB


@pytest.mark.parametrize("split", [1000, 20_000, 64 << 20])
def test_source_reads_every_member_once(spark, tmp_path, split):
    want = {}
    for a in range(3):
        members = {f"m{k}.txt": text(100 * a + k) for k in range(120)}
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{a}.zip").write_bytes(zipped(members, zipfile.ZIP_STORED))
        (tmp_path / f"in/{a}.tar.xz").write_bytes(tarred(members, "w:xz"))
        for m, body in members.items():
            want[f"{a}.zip!{m}"] = want[f"{a}.tar.xz!{m}"] = body.decode()
    (tmp_path / "broken.zip").write_bytes(b"PK no archive" * 5000)
    df = archives.read(spark, str(tmp_path), splitBytes=split)
    assert split > 1000 or df.rdd.getNumPartitions() > 50
    rows = df.collect()
    assert {r.path.split("/")[-1]: r.content for r in rows if r.status == "ok"} == want and len(rows) == len(want) + 1
    assert [(r.status, r.path.split("/")[-1]) for r in rows if r.status != "ok"] == [("failed", "broken.zip")]
    assert archives.read(spark, str(tmp_path / "in/1.zip")).count() == 120
    assert archives.read(spark, str(tmp_path), mostFiles=5).where("status = 'skipped'").count() == 6 * 115


def test_scan_of_split_archives(spark, tmp_path):
    secret = "github_token = ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7cF0hJ3lM6"
    body = ("x = 1\n" * 3_000 + secret + "\n" + "y = 2\n" * 3_000).encode()
    (tmp_path / "big.zip").write_bytes(zipped({"app.py": body, "conf.json": b'{"service": {"auth_token": "zipped-token-99"}}'}))
    found = engine.scan_archives(spark, str(tmp_path), partBytes=5_000).collect()
    got = {(r.path.split("!")[-1], r.line, r.value) for r in found}
    assert ("app.py", 3_001, secret.split(" = ")[1]) in got and any(p == "conf.json" and v == "zipped-token-99" for p, _, v in got)
    engine.release(spark)


def test_rows_and_unread(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("create table auth_tokens (name text primary key, token text) without rowid")
    db.executemany("insert into auth_tokens values (?, ?)", [(f"n{k:05}", f"token-value-{k:05}") for k in range(2000)])
    db.execute("create table user_keys (token text)")
    db.execute("insert into user_keys values ('later-table-value')")
    db.commit()
    db.close()
    good = (tmp_path / "x.db").read_bytes()
    # The last page of the first table is made unreadable; the other table is still there.
    pages = bytearray(good)
    for at in range(4096, len(pages), 4096):
        if b"token-value-01500" in pages[at : at + 4096]:
            pages[at : at + 8] = b"\xff" * 8
    binary = spark.createDataFrame([("x.db", good), ("y.db", bytes(pages)), ("no.db", b"zz" * 600), ("a.zip", zipped({"k.txt": b"v", "in.7z": b"?"})), ("b.zip", b"PK"), ("t.tar.xz", tarred({"f": b"g"}, "w:xz"))], "path string, content binary")
    rows = parsers.sqlite_items(binary.where("path = 'x.db'")).collect()
    assert len(rows) == 2001 and {r.key for r in rows} == {"auth_tokens.token", "user_keys.token"} and {r.line for r in rows if r.key.startswith("auth")} == set(range(1, 2001))
    hurt = parsers.sqlite_rows(binary.where("path = 'y.db'")).collect()
    assert [r.key for r in hurt if r.type == "failed"] == ["auth_tokens"] and "later-table-value" in {r.value for r in hurt}
    told = {r.path: r.status for r in engine.unread(spark, binary).collect()}
    assert told == {"y.db!auth_tokens": "failed", "no.db": "failed", "b.zip": "failed"}
    assert {(r.path, r.content) for r in parsers.archive_files(binary.where("path like '%.tar.xz'")).collect()} == {("t.tar.xz!f", "g")}
    assert spark.createDataFrame([("t.tar.xz",)], "path string").select(files.route(files.F.col("path")).alias("r")).first().r == "binary"
