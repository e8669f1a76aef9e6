import hashlib
import random
import re
import zlib

import pytest

from lumenframe.llm import periodic_runs as P
from lumenframe.llm import queries


def brute(w):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(12, 2 * q):
                out.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in out.items())


def made(rng):
    letters, w = rng.choice(["ab", "abc", "abcdefgh"]), []
    while len(w) < rng.randint(1, 160):
        k, p = rng.random(), [rng.choice(letters) for _ in range(rng.randint(1, 20))]
        if k < 0.3:
            w += p
            continue
        if k < 0.6:  # a period that holds a run of its own
            p = [rng.choice(letters)] * rng.randint(1, 20) + p[: rng.randint(0, 2)]
        w += (p * rng.randint(2, 8))[: rng.randint(1, 150)]
        if rng.random() < 0.1:
            w.append(str(rng.random()))
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_made_up_words(seed):
    rng = random.Random(seed)
    for _ in range(500):
        w = made(rng)
        assert P.runs_of([x.encode() for x in w]) == brute(w), w


def test_scales_share_out_the_periods():
    of = {}
    for k in range(1, 12):
        for a, z in P.periods(1 << k):
            for q in range(a, z + 1):
                assert q not in of
                of[q] = 1 << k
    assert sorted(of) == list(range(1, len(of) + 1))
    assert all(max(q, 12 - q) >= 2 * b - 1 for q, b in of.items())


def test_seeds_in_pieces(monkeypatch):
    w = [b"a"] * 50 + [b"b"] + ([b"a"] * 30 + [b"c"]) * 9
    whole = P.runs_of(w)
    monkeypatch.setattr(P, "SEEDS", 7)
    assert P.runs_of(w) == whole == brute([x.decode() for x in w])


def test_long_texts_that_repeat_throughout():
    assert P.runs_of([b"a"] * 300_000) == [(0, 300_000, 1)]
    lines = ([b"a"] * 9_999 + [b"b"]) * 20
    got = P.runs_of(lines)
    assert (0, 200_000, 10_000) in got and len(got) == 21
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 100_000:
        a, b = b, b + a
    assert len(P.runs_of(b)) > 10_000


def test_collapse():
    w = [str(i).encode() for i in range(5)] * 4 + [b"end"]
    assert P.collapse(w, P.runs_of(w)) == [b"0", b"1", b"2", b"3", b"4", b"end"]
    assert P.collapse([b"a"], []) == [b"a"]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " \n".join(made(rng))) for i in range(-3, 150)] + [(1, None), (1, None), (None, "a " * 40), (400, ""), (401, "\t é" * 13), (402, "x\x00y " * 13), (403, "a b " * 12)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, `a.b` string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a " * 20, 7, 8, 9)], "doc_id long, text string, n_words int, `a.b` int, `q``` int")
    row = P.find(docs).first().asDict(recursive=True)
    assert row == {"doc_id": 1, "a.b": 8, "q`": 9, "n_words": 20, "runs": [{"start": 0, "length": 20, "period": 1}], "collapsed": "a"}
    assert P.find(docs.limit(0)).count() == 0
