"""SQLite files by ranges of rows, against a plain read."""

import sqlite3

import pytest

from glintmark.sources import databases


def build(path, n):
    db = sqlite3.connect(path)
    db.execute("create table user_tokens (id integer primary key, token text, note text)")
    db.executemany("insert into user_tokens values (?, ?, 'long enough note')", [(k * k - 50, f"token-{k:08}") for k in range(n)])
    db.execute("insert into user_tokens values (?, 'token-greatest', '')", (2**63 - 1,))
    db.execute("insert into user_tokens values (?, 'token-smallest', '')", (-(2**63),))
    db.execute("create table auth_names (name text primary key, token text) without rowid")
    db.executemany("insert into auth_names values (?, ?)", [(f"n{k:05}", f"named-{k:08}") for k in range(300)])
    db.execute("create table config (rowid text, secret text)")
    db.executemany("insert into config values (?, ?)", [("r", f"config-{k:08}") for k in range(50)])
    db.execute("create table empty_keys (token text)")
    db.execute("create table fruit (token text)")
    db.execute("insert into fruit values ('not-in-a-telling-table')")
    db.commit()
    db.close()


@pytest.mark.parametrize("share", [3_000, 1 << 30])
def test_ranges_give_every_row_once(spark, tmp_path, share):
    build(tmp_path / "a b#1?.db", 4000)
    (tmp_path / "no.db").write_bytes(b"zz" * 600)
    (tmp_path / "none.sqlite").write_bytes(b"")
    want = {("user_tokens.token", f"token-{k:08}", k * k - 50) for k in range(4000)} | {("user_tokens.token", "token-greatest", 2**63 - 1), ("user_tokens.token", "token-smallest", -(2**63))}
    want |= {("auth_names.token", f"named-{k:08}", k + 1) for k in range(300)} | {("config.secret", f"config-{k:08}", k + 1) for k in range(50)}
    names = databases.tree.listing(spark, str(tmp_path))
    cut = databases.ranges(names, share).where("table = 'user_tokens'").count()
    assert cut > 20 if share < 10_000 else cut == 1
    rows = databases.read(spark, str(tmp_path), share=share).collect()
    got = [(r.key, r.value, r.row) for r in rows if r.type == "sqlite"]
    assert set(got) == want and len(got) == len(want)
    assert [r.path.rsplit("/", 1)[1] for r in rows if r.type == "failed"] == ["no.db"]


def test_damaged_page(spark, tmp_path):
    build(tmp_path / "x.db", 4000)
    pages = bytearray((tmp_path / "x.db").read_bytes())
    hurt = next(at for at in range(4096, len(pages), 4096) if b"token-00002000" in pages[at : at + 4096])
    pages[hurt : hurt + 8] = b"\xff" * 8
    (tmp_path / "x.db").write_bytes(bytes(pages))
    rows = databases.read(spark, str(tmp_path), share=3_000).collect()
    values = {r.value for r in rows if r.type == "sqlite"}
    assert {r.key for r in rows if r.type == "failed"} == {"user_tokens"}
    assert {"token-00000001", "token-greatest", "token-smallest", "named-00000299"} <= values and "token-00002000" not in values
