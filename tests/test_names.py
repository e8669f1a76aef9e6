import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import names
from lumenframe.operators.names import Names, decomposed


def one_by_one(text, known):
    people = []
    for name in sorted({n.strip(" ") for n in known if n and n.strip(" ")}, key=lambda n: (-len(n), n)):
        pattern = re.compile(rf"\b{re.escape(name)}\b", re.IGNORECASE)
        if pattern.search(text):
            people.append(name)
            text = pattern.sub(" ", text)
    return text, people


@pytest.mark.parametrize("alphabet", ["ab ", "aB-", "aé #", "ab-  "])
def test_same_as_one_by_one(alphabet):
    rng = random.Random(alphabet)
    word = lambda most: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, most)))
    for _ in range(3000):
        known, text = [word(5) for _ in range(rng.randint(0, 6))], word(25)
        assert Names(known).taken(text) == one_by_one(text, known), (text, known)


CASES = [(1, "John Smith and john, with Ann-Lee"), (2, None), (3, "  "), (4, "the of JOHN"), (5, "ann lee #1 x" * 50), (1, "John Smith and john, with Ann-Lee")]
KNOWN = [("John",), ("john",), ("John Smith",), (None,), (" ",), ("Ann",), (" Lee ",), ("#",)]


@pytest.mark.parametrize("most", [10**6, 3])
def test_tables(spark, most):
    asked = spark.createDataFrame(CASES, "`a.b` int, q string").withColumn("name", F.lit("kept"))
    got = decomposed(asked, spark.createDataFrame(KNOWN, "name string"), most_chars=most).collect()
    want = sorted((k, q, one_by_one((q or "").strip(" "), [n for (n,) in KNOWN])[1]) for k, q in CASES if q) + [(2, None, [])]
    assert sorted((r["a.b"], r["q"], r["people"]) for r in got if r["q"]) + [(r["a.b"], None, r["people"]) for r in got if r["q"] is None] == want
    assert {r["a.b"]: r["visual_query"] for r in got}[4] == "the of JOHN" and {r["name"] for r in got} == {"kept"}


@pytest.mark.parametrize("most", [10**6, -1])
def test_no_rows(spark, most):
    asked, none = spark.createDataFrame([(1, "a John")], "id int, q string"), spark.createDataFrame([], "name string")
    assert [tuple(r) for r in decomposed(asked, none, most_chars=most).collect()] == [(1, "a John", "john", [], ["a", "john"])]
    assert decomposed(asked.limit(0), spark.createDataFrame(KNOWN, "name string"), most_chars=most).count() == 0


def test_time_does_not_grow_with_the_names():
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200)) for _ in range(100)]
    took = []
    for n in (100, 100_000):
        known = Names([f"w{k} w{k + 1}" for k in range(n)])
        began = time.perf_counter()
        for t in texts:
            known.taken(t)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0] + 0.05
    assert names.MOST_CHARS >= 10**6
