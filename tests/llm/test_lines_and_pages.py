import base64
import hashlib
import random

import duckdb
import pandas as pd

from lumenframe.llm import line_dedup as N
from lumenframe.llm import storage
from lumenframe.llm import url_filter as U
from lumenframe.llm import warc as W


def lines(rng, n, lo=4, hi=30):
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(rng.randint(lo, hi))) for _ in range(n)]


def brute(docs, least=50):
    """docs: (id, text), in order; the texts without any run of ``least`` words that stood before, every run compared."""
    seen, out = set(), []
    for _, text in docs:
        if text is None:
            out.append(None)
            continue
        rows = text.split("\n")
        full = [i for i, x in enumerate(rows) if x.split()]
        gone = set()
        for a in range(len(full)):
            for b in range(a, len(full)):
                run = tuple(rows[i] for i in full[a : b + 1])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone |= set(range(full[a], full[b] + 1))
                    seen.add(run)
        out.append("\n".join(x for i, x in enumerate(rows) if i not in gone))
    return out


def test_repeated_runs(spark):
    rng = random.Random(8)
    passages = [lines(rng, rng.randint(1, 6)) for _ in range(6)] + [[" ".join(["word"] * 60)], ["short one"] * 40]
    docs = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice(passages) if rng.random() < 0.6 else lines(rng, rng.randint(1, 5))
            parts += [""] * rng.randint(0, 2)
        docs.append((k, "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[3][1])]
    frame = spark.createDataFrame([(d, t, len(t or ""), "x", "y", 1) for d, t in docs], "doc_id long, text string, n_chars long, line string, __lf_runs string, __lf_id int")
    got = {r["doc_id"]: r for r in N.remove_repeated(frame, count_column="gone").collect()}
    want = brute(docs)
    for (d, t), new in zip(docs, want, strict=True):
        assert got[d]["text"] == new and got[d]["n_chars"] == len(new or "") and got[d]["line"] == "x"
        assert (got[d]["gone"] > 0) == (new != t)
    assert sum(new != t for (_, t), new in zip(docs, want, strict=True)) > 20


def test_whole_runs_go_to_both_ends(spark):
    rng = random.Random(10)
    long, short = lines(rng, 1, 60, 60), lines(rng, 1, 30, 30)
    passages = [lines(rng, rng.randint(1, 9)) for _ in range(6)] + [long + short, short + long, ["short one"] * 40]
    docs = [(1, "\n".join(["intro a", *long, *short, "end a"])), (2, "\n".join(["intro b", *long, "", *short, "end b"]))]
    for k in range(3, 50):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice(passages) if rng.random() < 0.6 else lines(rng, rng.randint(1, 5))
            parts += [""] * rng.randint(0, 2)
        docs.append((k, "\n".join(parts)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, N.remove_repeated(frame, count_column="gone").collect()))
    want = brute(docs)
    assert [(d, t) for d, t, _ in got] == [(d, new) for (d, _), new in zip(docs, want, strict=True)]
    assert got[1][1:] == ("intro b\nend b", 3)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    assert got == sorted(con.sql(N.sql()).fetchall())


def test_repeated_rows_and_missing_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, text), (None, text), (2, "intro line\n" + text + "\nlast")]
    got = sorted(map(tuple, N.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, text), (1, text), (None, ""), (2, "intro line\nlast")], key=str)
    assert N.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = N.windows(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGES = "page_id long, url string, html string, winner string"


def test_archives_round_trip(spark):
    rng = random.Random(9)
    rows = [(k, f"http://a/{k}", "<p>" + rng.choice(["same", "other " * 50, f"page {k} " * 40]) + "</p>", "") for k in range(200)]
    rows += [(500, "u", None, ""), (501, None, "", ""), (None, "", "x", ""), (None, "n", "x", ""), (7, "http://a/7", rows[7][2], ""), (600, "é\nü", "é" * 90_000, "")]
    pages = spark.createDataFrame(rows, PAGES)
    files = W.write(pages, storage.new_folder(spark, "w"), file_bytes=20_000)
    got = W.read(spark, files).collect()
    assert len(got) == len(rows) == sum(f["records"] for f in files)
    last = {}
    for p, _, h, _ in rows:
        last[h or ""] = max(p if p is not None else -1, last.get(h or "", -1))
    want = []
    for p, u, h, _ in rows:
        body = (h or "").encode()
        winner = last[h or ""]
        kind = "response" if winner in (-1, p) else "revisit"
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((p, u, len(body), digest, kind, None if kind == "response" else winner, body if kind == "response" else None))
    clean = [(*r[:6], bytes(r[6]) if r[6] is not None else None) for r in map(tuple, got)]
    assert sorted(clean, key=str) == sorted(want, key=str)
    small = W.read(spark, W.write(pages, storage.new_folder(spark, "w"), min_bytes=1000)).where("record_type = 'revisit'")
    assert small.count() == 0
    assert W.read(spark, W.write(pages.limit(0), storage.new_folder(spark, "w"))).count() == 0


def test_dictionary_frame_is_skippable(spark):
    import zstandard

    files = W.write(spark.createDataFrame([(1, "u", "x" * 500, "")], PAGES), storage.new_folder(spark, "w"))
    store, path = storage.open_store(files[0]["path"])
    with store.open_input_stream(path, compression=None) as f:
        data = f.read()
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    size = int.from_bytes(data[4:8], "little")
    assert data[8 + size : 12 + size] == zstandard.FRAME_HEADER
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])))
    first = reader.decompressobj()
    told = first.decompress(data[8 + size :])
    assert b"WARC-Type: warcinfo" in told and W.parse(told) is None
    page = reader.decompressobj().decompress(first.unused_data)
    assert b"Content-Type: application/http; msgtype=response" in page and b"\r\n\r\nHTTP/1.1 200 OK\r\n" in page and W.parse(page)["payload"] == b"x" * 500


def test_revisits_name_the_response():
    first, again = (W.record(k, "http://a/é", b"same", W.digest_of(b"same"), None if k == 9 else (9, "http://a/é"), "2024-01-01T00:00:00Z").decode() for k in (9, 3))
    name = first.split("WARC-Record-ID: ")[1].split("\r\n")[0]
    assert f"WARC-Refers-To: {name}\r\n" in again and again.endswith("Content-Length: 4\r\n\r\n\r\n\r\n")


def test_rules_and_aliases(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "http://a.net/x", None), (2, "http://b.org/y", link % "http://a.net/x"), (3, "http://c.org/z", '<META HTTP-EQUIV=refresh content="0; URL=/q?a=1&amp;b=2">'), (4, "http://c.org/q?a=1&b=2", "x"), (5, "http://b.org/w", link % "y"),
        (6, "http://d.org/fr/1", link % "//a.net/x"), (7, None, link % "x"), (8, "http://e.com/k", link % "http://f.net/gone"), (9, "nothing", ""), (10, "HTTP://Sub.EXAMPLE.net/en/p", None), (11, "http://example.net/de/", ""), (12, "http://net?x", ""),
        (13, "http://notnet/x", ""), (2, "http://b.org/y", None), (14, "http://r.com/", "x"), (None, "http://s.com/", "x"),
    ]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, html string, host string, verdict string")
    moved = spark.createDataFrame([("http://r.com/", "http://s.com/"), ("http://s.com/", "http://f.net/gone"), (None, "x")], "url string, target string")
    got = sorted(((r["page_id"], r["rule"], r["verdict"]) for r in U.judge(pages, redirects=moved).collect()), key=str)
    block, allow = "block", "allow"
    want = [(1, "net/", block), (2, None, block), (2, None, block), (3, None, allow), (4, None, allow), (5, None, block), (6, "org/fr/", allow), (7, None, allow), (8, None, block), (9, None, allow), (10, "example.net/en/", allow), (11, "net/", block), (12, None, allow), (13, None, allow), (14, None, block), (None, None, block)]
    assert got == sorted(want, key=str)
    hosts = {r["page_id"]: (r["host"], r["path"]) for r in U.judge(pages).collect()}
    assert hosts[10] == ("sub.example.net", "/en/p") and hosts[12] == ("net", "") and hosts[9] == hosts[7] == ("", "")
    assert U.judge(pages.limit(0)).count() == 0 and U.judge(pages, rules=[]).where("verdict = 'block'").count() == 0


def test_sql_of_pages_equals_the_operators(spark):
    link = '<html><link href="%s" rel="canonical"></html>'
    rows = [(1, "http://a.net/x", ""), (2, "http://b.org/y?q#f", link % "http://a.net/x"), (3, "http://c.org/z/", link % "../k"), (4, "http://d.org/fr/1", link % "//a.net/x"), (5, None, link % "x"), (6, "http://e.com/k", link % "http://f.net/gone"), (7, "http://e.com", link % "k"), (8, "é", "é" * 30), (9, "http://a.net/x", None), (10, "x", "é" * 30), (11, "http://g.com/a#top", link % "HTTP://H.com:80"), (12, "http://h.com/#f", ""), (13, "https://H.com:443/z?q=1#f", link % "https://g.com/b"), (14, "http://G.com:80/a", link % "http://f.net/gone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    ours = U.judge(pages).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, ours)) == sorted(con.sql(U.SQL).fetchall())
    assert {r["page_id"] for r in ours if r["verdict"] == "block"} == {1, 2, 6, 7, 9, 11, 12, 14}
    read = W.read(spark, W.write(pages, storage.new_folder(spark, "w"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, read)) == sorted(con.sql(W.SQL).fetchall())
