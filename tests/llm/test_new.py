"""Fill-in-middle, URL filters and phrase mining: brute force, SQL on awkward rows, ropes, sweeps, block and batch borders."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glintmark.llm import fim, phrases, urlfilter

DOC = "doc_id long, text string, lang string"


def sql_rows(duck, sql, **tables):
    with duck.cursor() as c:
        for name, df in tables.items():
            c.register(f"given_{name}", df.toArrow())
            sql = sql.replace(f"FROM {name}", f"FROM given_{name}")
        found = c.execute(sql)
        names = [d[0] for d in found.description]
        return Counter(tuple(sorted(zip(names, r))) for r in found.fetchall())


def rows_of(df):
    return Counter(tuple(sorted(r.asDict().items())) for r in df.collect())


# 11 fill in the middle


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 4096])
def test_rope(monkeypatch, leaf):
    monkeypatch.setattr(fim, "LEAF", leaf)
    rnd = random.Random(leaf)
    for _ in range(200):
        text = "".join(rnd.choice("ab\n😀é<") for _ in range(rnd.randrange(40)))
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        r = fim.rope(text)
        assert fim.text_of(r) == text and (r.units if r else 0) == len(lines)
        for k in range(len(lines) + 1):
            at = fim.place(r, k)
            assert at == len("".join(lines[:k]))
            left, right = fim.split(r, at)
            assert fim.text_of(left) == text[:at] and fim.text_of(right) == text[at:]
            assert (left.units if left else 0) == k and (right.units if right else 0) == len(lines) - k
            assert fim.text_of(fim.concat(right, left)) == text[at:] + text[:at]
        for draw in range(8):
            draws = [rnd.randrange(1 << 32) for _ in range(3)] + [draw * 13]
            n, form, before, within, out = fim.transformed(text, draws, 100, 50, fim.Sentinels())
            assert n == len(lines) and fim.restored(out, form) == text and (form == "plain") == (not text)
            if form != "plain":
                low, high = sorted(x % (n + 1) for x in draws[:2])
                pre, mid, suf = ("".join(lines[a:b]) for a, b in ((0, low), (low, high), (high, n)))
                assert out == (f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}") and (before, within) == (len(pre), len(mid))


def test_rope_stays_balanced():
    r = fim.rope("x" * 4096 * 1000)
    for k in range(1, 60):
        left, right = fim.split(r, k * 60_001)
        r = fim.concat(right, left)
    assert r.chars == 4096 * 1000 and r.height < 40


def fim_rows(spark):
    long = "\n".join(f"line {i} of a long text" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "one line"), (3, "one line"), (4, "\n\n\n"), (None, "a\nb\nc\nd"), (6, "has <S> inside\nx"), (7, long), (8, "y" * 500_000), (9, "é😀\r\n\u2028x\nend"), (10, "<P\n>S>\n<")]
    return spark.createDataFrame([(i, t, "en") for i, t in rows], DOC).withColumns({"form": F.lit(1), "N": F.lit("n"), "fim": F.lit(2.5), "a0": F.lit("a")})


def test_fim_awkward_agrees_with_sql(spark, duck, monkeypatch):
    docs = fim_rows(spark)
    docs.createOrReplaceTempView("fim_docs")
    monkeypatch.setattr(fim.shared, "table", lambda *_: docs)
    assert rows_of(fim.op11_fill_in_middle(spark, "")) == sql_rows(duck, fim.OP11_SQL, documents=docs)


def test_fim_columns_rates_and_null(spark):
    docs = fim_rows(spark)
    out = fim.transform(docs)
    assert out.columns == ["doc_id", "text", "lang", "a0", "n", "form", "prefix_chars", "middle_chars", "fim"]
    back = fim.restore(out).collect()
    assert all(r.restored == (r.text or "") for r in back) and {r.form for r in back if r.text and "<S>" not in r.text} <= {"psm", "spm"}
    assert {r.form for r in fim.transform(docs, rate=0).collect()} == {"plain"}
    marks = fim.Sentinels("<a>", "<b>", "<c>")
    assert all(fim.restored(r.fim, r.form, marks) == (r.text or "") for r in fim.transform(docs, marks=marks, spm_rate=0).collect())
    assert fim.transform(docs.limit(0)).count() == 0
    assert fim.restore(spark.createDataFrame([(None, "plain")], "fim string, form string")).first().restored is None
    draws = spark.range(1).select(fim.draws(F.lit(42)).alias("d")).first().d
    h = hashlib.sha256(b"7:42").hexdigest()
    assert draws == [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


# 12 URL filters


def verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


AWKWARD_URLS = [None, "", "no scheme", "://", "http://", "http:///net/", "http://NET/", "http://net", "http://net?x/", "http://a.net/#f", "http://example.net/en/", "http://w.EXAMPLE.net/en/x?y#z", "http://example.net./en/", "http://example.net:80/en/",
                "http://xexample.net/en", "http://example.net/EN/", "http://a..net/", "http://net.\u0001/", "x://y://net/", "http://a.org/fr/\n/é😀", "http://org/fr/\U0010ffff", "http://.net/", "http://u@net/", "HTTP://a.b.c.d.example.com/de/"]


def test_urls_awkward(spark, duck, monkeypatch):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(AWKWARD_URLS)] + [(None, "http://a.net/"), (1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string").withColumns({"rule": F.lit(1), "Verdict": F.lit(2), "key": F.lit(3), "row": F.lit(4)})
    monkeypatch.setattr(urlfilter.shared, "table", lambda *_: pages)
    got = rows_of(urlfilter.op12_url_filter(spark, ""))
    assert got == sql_rows(duck, urlfilter.OP12_SQL, pages=pages)
    assert got == Counter(tuple(sorted(zip(("host", "path", "rule", "verdict", "page_id"), (*verdict(r.url, urlfilter.RULES), r.page_id)))) for r in pages.collect())
    every = urlfilter.judge(pages, spark.range(1).select(F.inline(F.array(F.struct(F.lit("net").alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))))))
    assert every.columns == ["page_id", "url", "key", "row", "host", "path", "rule", "verdict"] and every.count() == pages.count()


@pytest.mark.parametrize("seed", range(2))
def test_urls_random_rules(spark, seed, monkeypatch):
    monkeypatch.setattr(urlfilter, "RANGES", (1, 9)[seed])
    rnd = random.Random(seed)
    name = lambda: ".".join(rnd.choice(["a", "b", "ab", "b-", "é", "net"]) for _ in range(rnd.randrange(1, 5)))
    path = lambda: "".join(rnd.choice(["/", "/a", "/ab", "b", "é", "\U0010ffff"]) for _ in range(rnd.randrange(5)))
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h, p in ((name(), rnd.choice(["", "/"]) + path()) for _ in range(120))}.values())
    urls = [(k, f"http://{name()}/{path()}") for k in range(800)] + [(k, "http://a.b.net/a/hot") for k in range(800, 1600)]
    rows = rules + [(None, "/", "block"), ("a", "x", "block"), ("b", None, "allow")]
    rules = [r for r in rules if not r[1] or r[1][0] == "/"] + ([("b", "", "allow")] if not any(r[:2] == ("b", "") for r in rules) else [])
    rules = [("b", "", "block") if r[:2] == ("b", "") and r[2] == "block" else r for r in rules]
    got = urlfilter.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rows, "host string, path string, verdict string"), default="none")
    want = {k: verdict(u, rules, "none") for k, u in urls}
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    # Equally long rules: the one with the longer host.
    assert found == want
    assert got.sparkSession is spark and "Python" not in got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_urls_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert urlfilter.judge(pages, none).count() == 0
    assert urlfilter.judge(spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string"), none).first().verdict == "allow"


# 13 phrases


def plain_phrases(docs, least, most, absorb, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in cand.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        around[p[i:j]] = max(around[p[i:j]], a)
        rows = []
        for p, a in cand.items():
            if not around[p] or 100 * around[p] < absorb * a:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return Counter(out)


def phrase_docs(seed, rows=120):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "a", "\x01", "é", "x-y", "😀", "ab", "\xa0", "b"]
    sep = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!"]
    make = lambda: "".join(rnd.choice(words) + rnd.choice(sep) for _ in range(rnd.randrange(40)))
    out = [(make(), rnd.choice(["en", "de", None, "und"])) for _ in range(rows)]
    return out + [("to be or not to be", "en")] * 30 + [(None, "en"), ("", "fr"), (" . ", "fr"), ("one two", "fr")] + [("hot passage of ten words that many documents share here", "en")] * 80


@pytest.mark.parametrize("least, most, absorb, top, rows", [(10, 5, 100, 2000, 10_000), (3, 5, 80, 7, 5), (25, 3, 100, 2000, 2), (4, 2, 100, 5, 5)])
def test_phrases_brute_force(spark, least, most, absorb, top, rows):
    """rows: of a block; in small ones most phrases touch an edge."""
    docs = phrase_docs(least)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        frame = spark.createDataFrame(docs, "text string, lang string").withColumns({"phrase": F.lit(1), "n": F.lit(2), "k": F.lit("x")})
        got = Counter(tuple(r) for r in phrases.collocations(frame, least=least, most=most, absorb=absorb, top=top).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    want = plain_phrases(docs, least, most, absorb, top)
    assert got == want and len(want) > 5, ((got - want), (want - got))


@pytest.mark.parametrize("words, part, reach", [(1 << 18, 1 << 20, 4), (10, 5, 4), (3, 1, 1), (7, 2, 0), (2, 100, 4)])
def test_blocks_begin_each_place_once(monkeypatch, words, part, reach):
    monkeypatch.setattr(phrases, "WORDS", words)
    monkeypatch.setattr(phrases, "PART", part)
    texts = [(t or "").encode() for t, _ in phrase_docs(reach, 60)] + [b"long " * 300, b"x" * 50]
    got, want = Counter(), Counter()
    for dictionary, codes, pieces, starts in phrases.blocks(map(memoryview, texts), reach):
        w = dictionary.to_pylist()
        for i in range(starts):
            got[tuple(w[codes[j]] for j in range(i, min(i + reach + 1, len(codes))) if pieces[j] == pieces[i])] += 1
    for t in texts:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", t.lower()):
            p = piece.split()
            want.update(tuple(p[i : i + reach + 1]) for i in range(len(p)))
    assert got == want


def test_phrases_sql_on_awkward_rows(spark, duck, monkeypatch):
    docs = spark.createDataFrame([(t, x) for t, x in phrase_docs(5) * 6], "text string, lang string")
    monkeypatch.setattr(phrases.shared, "table", lambda *_: docs)
    got = rows_of(phrases.op13_phrase_collocations(spark, ""))
    assert got == sql_rows(duck, phrases.OP13_SQL, documents=docs) and got
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_large_numbers_are_exact(spark):
    a, n, l, r = 10**13, 10**14, 10**13 + 7, 10**13 + 9
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert df.select(phrases.score().alias("s")).first().s == 1000 * a * n // (l * r)


def test_map_of_pairs_never_misses(spark):
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 1 << 64, 5000, dtype=np.uint64)
    held = phrases.PairMap(spark.createDataFrame(pa.table({"h": h.view(np.int64)})))
    assert held.holds(h).all() and held.holds(rnd.integers(0, 1 << 64, 5000, dtype=np.uint64)).mean() < 0.02
    assert not phrases.PairMap(spark.createDataFrame([], "h long")).holds(h).any()
    assert held.bits == phrases.FEWEST_BITS


def test_phrases_read_texts_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def text(k):
        seen.add(1)
        return "to be or not to be" if k % 2 else None

    docs = spark.range(400, numPartitions=2).select(F.udf(text).asNondeterministic()("id").alias("text"), F.lit("en").alias("lang"))
    got = [tuple(r) for r in phrases.collocations(docs).collect()]
    assert [(r[2], r[3], r[6]) for r in got] == [("to be", 400, 1200), ("be or not to be", 200, 1200), ("to be or not to", 200, 1200)]
    assert 0 < seen.value <= 2 * 400


def test_hashes_leave_a_task_packed():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["ab", "cd", str(rnd.randrange(9_000))]) for _ in range(2_000)) for _ in range(40)]
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    packed = list(phrases.count_hashes(iter([batch])))
    pairs = {p for t in texts for p in zip(t.split(), t.split()[1:])}
    assert sum(b.num_rows for b in packed) <= 1 << phrases.SLOT_BITS < len(pairs)
    want = Counter(p for t in texts for p in zip(t.split(), t.split()[1:])) + Counter(w for t in texts for w in t.split())
    for least in (1, 3, 100):
        got = list(phrases.frequent_hashes(least)(b.slice(at, 700) for b in packed for at in range(0, b.num_rows, 700)))
        assert sum(b.num_rows for b in got) == sum(n >= least for n in want.values()) > 0


def test_hashes_summed_over_tasks():
    rnd = np.random.default_rng(5)
    tops = rnd.integers(0, 1 << 64, 30, dtype=np.uint64) >> np.uint64(50) << np.uint64(50)
    tasks = [rnd.choice(tops, 3_000) + rnd.integers(0, 40, 3_000, dtype=np.uint64) for _ in range(6)]
    rows = sorted(((r["slot"], r["h"], r["n"]) for x in tasks for r in phrases.packed(*np.unique(x, return_counts=True)).to_pylist()), key=lambda r: r[0])
    want = sorted(int(h) for h, n in Counter(np.concatenate(tasks).tolist()).items() if n >= 16)
    for size in (1, 7, 1000):
        batches = (pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[at : at + size]), (pa.int32(), pa.binary(), pa.binary()))], names=["slot", "h", "n"]) for at in range(0, len(rows), size))
        got = [h for b in phrases.frequent_hashes(16)(batches) for h in b.column(0).to_numpy().view(np.uint64).tolist()]
        assert sorted(got) == want and want
    assert sum(b.num_rows for b in phrases.frequent_hashes(1)(iter([]))) == 0


def test_hashes_of_words():
    words = ["a", "b", "ab", "ba", "é", "\x00", "\x00\x00", "x" * phrases.LONG, "x" * (phrases.LONG + 1), "y" * 5_000, "x" * 5_000]
    one = phrases.hashes("en", pa.array(words).cast(pa.binary()))
    assert len(set(one.tolist())) == len(words) and not set(one.tolist()) & set(phrases.hashes("de", pa.array(words).cast(pa.binary())).tolist())
    assert phrases.hashes("en", pa.array(words[::-1]).cast(pa.binary())[1:]).tolist() == one[::-1][1:].tolist()
    assert len(phrases.hashes("en", pa.array([], pa.binary()))) == 0


@pytest.mark.parametrize("pairs, nexts, size", [(1, 1, 3), (2, 2, 1), (3, 2, 10), (50, 7, 25), (5, 3, 100_000)])
def test_growth_in_blocks_of_colliding_keys(pairs, nexts, size):
    """Keys of so few values that runs of different phrases mix, in blocks of size rows."""
    rnd, most, least = random.Random(size), 5, 6
    want, rows = Counter(), []
    bits = phrases.next_bits(most)
    few = lambda x, n: sum(" ".join(x).encode()) % n
    for lang in ("en", "de"):
        for _ in range(60):
            w = [rnd.choice("abcdé") for _ in range(rnd.randrange(12))]
            for i in range(len(w) - 1):
                x = w[i : i + most]
                place = (few(x[:2], pairs) << 64 - phrases.PAIR_BITS) + sum(few(y, nexts) << 64 - phrases.PAIR_BITS - bits * k for k, y in enumerate(x[2:], 1))
                n = rnd.randrange(1, 3)
                rows.append((lang, " ".join(x).encode(), n, place))
                want.update({(lang, " ".join(x[:k])): n for k in range(2, len(x) + 1)})
    rnd.shuffle(rows)
    rows.sort(key=lambda r: r[3])
    kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64())
    batches = (pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[at : at + size]), kinds)], names=["lang", "words", "n", "place"]) for at in range(0, len(rows), size))
    got = Counter()
    for b in phrases.grown(least, most)(batches):
        for r in b.to_pylist():
            got[r["lang"], r["phrase"]] += r["n"]
    assert {p: n for p, n in got.items() if n >= least} == {p: n for p, n in want.items() if n >= least} != {}


def test_rows_that_differ_in_a_map_only(spark):
    from glintmark.llm import simhash

    rows = spark.createDataFrame([(1, "one two three four", {"a": 1}), (1, "one two three four", {"a": 1}), (1, "one two three four", {"b": 1}), (2, "quite another text here", None)], "doc_id long, text string, m map<string, int>")
    kept = simhash.keep_first(rows).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2]


def test_very_many_notices_in_one_text():
    import time

    from glintmark.llm import license_scan

    index = license_scan.index_of(tuple(license_scan.TEMPLATES.items()))
    notice = "é Released under the MIT License. "
    times = {}
    for n in (2_500, 20_000):
        text = (notice * n).encode()
        began = time.process_time()
        found = [m for m in license_scan.matches(index, text) if m[0] == "mit-line"]
        times[n] = time.process_time() - began
        assert len(found) == n and all(m[2] == 1 for m in found)
    assert times[20_000] < 20 * max(times[2_500], 0.1), times  # eight times as many


def test_code_points_of_places():
    from glintmark.llm import license_scan

    text = "aé日😀b".encode()
    assert license_scan.code_points(text, set(range(len(text) + 1))) == {n: len(text[:n].decode("utf-8", "replace")) for n in range(len(text) + 1)}
    assert license_scan.code_points(b"", {0}) == {0: 0}
