import random
import re

import pytest
from xxhash import xxh64_intdigest

from lumenframe.llm import simhash as S
from lumenframe.llm import storage
from lumenframe.llm.components import components


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(values):
    root = {x: x for x in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    out = {}
    for x in values:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", None, "  \n", "a", "A b", "a B c", "é É x \x0b y z w"] + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(100)]
    got = S.fingerprints_of([None if t is None else t.encode() for t in texts])
    assert [int(g) for g in got] == [signed(fingerprint(t)) for t in texts]


@pytest.mark.parametrize("bucket", [32, 1])
def test_links_of_clusters(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = random.Random(bucket)
    values = set()
    for c in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 60 if c < 3 else 4])):
            values.add(x)
            for _ in range(rng.choice([1, 1, 2, 3])):
                x ^= 1 << rng.randrange(32 if c % 2 else 64)
    frame = storage.cut(spark.createDataFrame([(signed(v),) for v in values], "fp long"))
    name = {r["node"]: r["component"] for r in components(S.links(frame)).collect()}
    got = {}
    for v in values:
        got.setdefault(name.get(signed(v), signed(v)), set()).add(v)
    assert sorted(map(sorted, got.values())) == groups(values)


def test_near_duplicates_and_survivors(spark):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(9, base), (4, base + " tail"), (7, base), (7, base), (1, "other text entirely here"), (None, base), (20, None), (21, ""), (22, " "), (30, "x"), (31, "X"), (40, "lone"), (40, "lone"), (50, "first of two texts"), (50, "second one, of other words")]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, fp string")
    near = (fingerprint(base) ^ fingerprint(base + " tail")).bit_count() <= 2
    got = {(r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()}
    first = 4 if near else 7
    assert got == {(9, first), (7, first), (4, 4), (None, first), (1, 1), (20, 20), (21, 20), (22, 20), (30, 30), (31, 30), (40, 40), (50, 50)}
    kept = sorted(str(r["doc_id"]) for r in S.keep_first(docs).collect())
    assert kept == sorted(["1", "4", "20", "30", "40", "50", "50", "None"] + ([] if near else ["7"]))
    assert S.keep_first(docs).columns == docs.columns
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.keep_first(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    rows = [(k, k + 1) for k in range(200)] + [(500, 499), (None, 3), (600, 600)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, 499: 499, 500: 499}
    text = components(spark.createDataFrame([("b", "a"), ("c", "b")], "u string, v string"))
    assert {tuple(r) for r in text.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
