import hashlib
import random
import re
from itertools import permutations
from math import factorial

import duckdb
import pytest

from lumenframe.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(doc_id, text, rows):
    words = WORD.findall(text or "")
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text or "")) > 5 * len(text or ""),
        "D": bool(re.search(r"[#$%&*|]", text or "")),
        "E": any((t or "") == (text or "") and i is not None and (doc_id is None or i < doc_id) for i, t, _ in rows),
    }


def brute(rows, labels):
    quality, toxic = {}, {}
    for i, q, t in (x for x in labels if x[0] is not None):
        quality[i], toxic[i] = max(q or 0, quality.get(i, 0)), max(t or 0, toxic.get(i, 0))
    docs = [(i, s or "", fails(i, t, rows)) for i, t, s in rows]
    out = {}
    for part in {s for _, s, _ in docs}:
        own = [(i, f) for i, s, f in docs if s == part]
        every = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [i for i, f in left if f[letter]]
                left = [(i, f) for i, f in left if not f[letter]]
                every[letter] += len(gone)
                failing = sum(f[letter] for _, f in own)
                only = sum(f[letter] and sum(f.values()) == 1 for _, f in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), only, sum(quality.get(i, 0) == 1 for i in gone), sum(toxic.get(i, 0) == 1 for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(every[order[step - 1]])
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = [(0, None, None), (1, "", "a"), (1, "", "a"), (None, "", "b"), (None, "same words", "b"), (7, "same words", None), (3, "É" * 60 + " AB", "a.b"), (2, "x " * 3000, "a")]
    for i in range(n):
        text = " ".join(rng.choice(["word", "Other", "the", "#", f"w{rng.randint(0, 90)}"][: rng.randint(1, 5)]) for _ in range(rng.choice([3, 49, 50, 80])))
        rows.append((rng.randint(5, n), text if rng.random() < 0.8 else "a copy " * 30, rng.choice([None, "", "a", "b", "hot", "hot", "hot"])))
    return rows


def test_against_every_order(spark):
    rows = rows_of(3, 80)
    labels = [(i, i % 2, i % 3 % 2) for i in range(60)] + [(5, 1, 1), (None, 1, 1), (900, 1, 0), (6, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, quality int, `a.b` int")
    got = A.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert dict(got.dtypes)["step"] == "int" and {t for c, t in got.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
    found = got.collect()
    assert len(found) == 600 * len({s or "" for _, _, s in rows})
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found} == brute(rows, labels)


def test_sums(spark):
    docs = spark.createDataFrame(rows_of(4, 40), "doc_id long, text string, source string")
    rows = A.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    n = {p: sum(r["removed"] for r in rows if r["part"] == p and r["filter_order"] == "ABCDE") + next(r["kept"] for r in rows if r["part"] == p and r["filter_order"] == "ABCDE" and r["step"] == 5) for p in {r["part"] for r in rows}}
    for p, total in n.items():
        left = next(r["kept"] for r in rows if r["part"] == p and r["step"] == 5)
        assert sum({r["filter_order"][r["step"] - 1]: r["shapley"] for r in rows if r["part"] == p}.values()) == factorial(5) * (total - left)
    assert all(not r["good_lost"] and not r["toxic_lost"] for r in rows)


def test_empty_and_another_part(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(none, labels).count() == 0
    docs = spark.createDataFrame([(1, "a", 3), (2, "a", None)], "doc_id long, text string, `the.part` int")
    assert {r["part"] for r in A.audit(docs, labels, "the.part").collect()} == {"3", ""}


@pytest.mark.parametrize("seed", [5, 6])
def test_sql(spark, seed):
    import pandas as pd

    rows = list({r[0]: r for r in rows_of(seed, 60) if r[0] is not None}.values())
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "int64"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]))
    want = con.execute(A.SQL)
    names = [c[0] for c in want.description]
    got = A.audit(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


def test_class_is_of_the_whole_text(spark):
    a, b = "x" * 100_000 + "a", "x" * 100_000 + "b"
    assert hashlib.sha256(a.encode()).digest() != hashlib.sha256(b.encode()).digest()
    docs = spark.createDataFrame([(1, a, "s"), (2, b, "s"), (3, a, "s")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["E"] for r in A.flagged(docs).collect()} == {1: False, 2: False, 3: True}
