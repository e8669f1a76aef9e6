import hashlib
import random

import numpy as np
import pytest

from lumenframe.llm import bwt, queries
from lumenframe.llm import suffix_dedup as S

LAST = S.LAST


def expected(rows, length=50):
    first = {}
    texts = [(i, LAST if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for _, i, t in texts:
        for a in range(len(t) - length + 1):
            w = t[a : a + length]
            first[w] = min(i, first.get(w, LAST))
    out = []
    for doc, i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - length + 1):
            if first[t[a : a + length]] < i:
                gone[a : a + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone.tolist(), strict=False) if not g)
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)

    def prose(k, letters="abcdefghi é\n"):
        return "".join(rng.choice(letters) for _ in range(k))

    shared = [prose(rng.randint(40, 400)) for _ in range(6)]
    rows = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind < 0.3 and rows:  # a near copy
            text = rng.choice(rows)[1] or ""
            a = rng.randint(0, len(text))
            text = text[:a] + prose(rng.randint(0, 3)) + text[a + rng.randint(0, 3) :]
        elif kind < 0.45:
            text = rng.choice("a=") * rng.randint(30, 300) + prose(20) + rng.choice(["ab", "xyz"]) * rng.randint(1, 60)
        else:
            text = "".join(rng.choice([prose(rng.randint(0, 90)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 39) :]]) for _ in range(rng.randint(0, 4)))
        rows.append((rng.choice([None, *range(2 * n)]), text or None))
    rng.shuffle(rows)
    return rows


def run(spark, tmp_path, rows, parts=3):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, removed int, `a.b` string").repartition(parts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op13_suffix_dedup(spark, str(tmp_path))


@pytest.mark.parametrize("seed", [1, 2])
def test_query(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(S, "SLICE", 300)  # of the driver; workers read the module anew
    rows = [*made(seed, 150), (-5, ""), (-5, None), (7, "x" * 49), (8, "x" * 50), (8, "x" * 50), (9, "x" * 51), (10, "\x00" * 60), (11, "\x00" * 55)]
    got = run(spark, tmp_path, rows)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_common_hashes_go_window_by_window(spark):
    rows = [(i, t) for i, (_, t) in enumerate(made(4, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = expected(rows)
    for common in (0, 1):
        got = S.digest(S.find(docs, common=common)).collect()
        assert sorted((tuple(r) for r in got), key=str) == want


def test_spans_and_bytes(spark):
    a, b = "0123456789" * 3 + "A fox ran over the hill and far away from the hounds!", "the quick brown dog sleeps while everyone else is at work"
    docs = spark.createDataFrame([(1, a), (2, "Start. " + a[5:] + " mid " + a), (0, b)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in S.find(docs).collect()}
    assert rows[1]["removed"] == [] and bytes(rows[0]["kept"]).decode() == b
    assert [tuple(s) for s in rows[2]["removed"]] == [(7, len(a) - 5), (7 + len(a), len(a))]
    assert bytes(rows[2]["kept"]) == b"Start.  mid "


def test_empty_table(spark):
    assert S.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_cover_each_window_once(monkeypatch):
    monkeypatch.setattr(S, "SLICE", 97)
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab=") for _ in range(rng.choice([0, 10, 49, 50, 51, 400]))) for _ in range(40)] + [b"=" * 500]
    ends = np.cumsum([len(t) for t in texts if t])
    text = np.frombuffer(b"".join(texts), np.uint8)
    start, n, key = S.pieces(text, ends)
    got = [(a + i, int(k)) for a, m, k in zip(start.tolist(), n.tolist(), key.tolist(), strict=True) for i in range(m)]
    want = [a for e, t in zip(ends.tolist(), (t for t in texts if t), strict=True) for a in range(e - len(t), e - 49)]
    assert [g[0] for g in got] == want and max(n) <= S.WINDOWS
    of = {}
    for a, k in got:  # equal windows have equal hashes
        assert of.setdefault(bytes(text[a : a + 50]), k) == k


@pytest.mark.parametrize("depth", [9, 16, 31, 50])
def test_common_prefixes(depth):
    rng = random.Random(depth)
    for trial in range(60):
        letters = b"ab" if trial % 2 else b"abcdefgh\x00\xf4"
        base = bytes(rng.choice(letters) for _ in range(300))
        contents = []
        for _ in range(rng.randint(1, 20)):
            a = rng.randint(0, 250)
            contents.append(rng.choice([base[a : a + rng.randint(0, 90)], base[a : a + 60] + bytes(rng.choice(letters) for _ in range(30)), b"a" * rng.randint(0, 80)]))
        whole, ends = b"".join(contents), np.cumsum([len(c) for c in contents])
        text, stops = bwt.joined(whole, ends)
        order, packed = bwt.suffix_order(text, stops, depth)
        shared = bwt.common_prefixes(text, order, packed, depth)
        stop = np.repeat(stops, np.diff(stops, prepend=-1))
        suffixes = [text[i : min(i + depth, stop[i])].tobytes() for i in order]
        assert suffixes == sorted(suffixes)
        for x, y, got in zip(suffixes[:-1], suffixes[1:], shared[1:].tolist(), strict=True):
            same = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert got == (depth if x == y else same if same >= bwt.PACKED else 0)
        offset, first = bwt.classes(whole, ends, depth)
        got = sorted(g for g in (sorted(int(x) for x in c if x >= 0) for c in np.split(offset, first[1:])) if g)
        want, at = {}, 0
        for c in contents:
            for i in range(len(c) - depth + 1):
                want.setdefault(c[i : i + depth], []).append(at + i)
            at += len(c)
        assert got == sorted(want.values())
