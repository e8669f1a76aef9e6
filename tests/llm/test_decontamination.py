import hashlib
import re

from lumenframe.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, spans string, item string"
ITEMS = "item_id long, text string, doc_id string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t, *_ in items:
        w = words(t)
        if i is not None and w:
            for a in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    out = []
    for d, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for window, owners in windows.items():
            for a in range(len(w) - len(window) + 1):
                if tuple(w[a : a + len(window)]) == window:
                    hit |= set(range(a, a + len(window)))
                    found |= owners
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
CASES = [
    (1, f"x {PASSAGE.upper()}, y"), (2, PASSAGE.replace("six", "6")), (3, None), (4, ""), (5, "!!! ..."), (6, "é été ünder é"), (7, f"{PASSAGE} {PASSAGE}"),
    (7, f"{PASSAGE} {PASSAGE}"), (None, "Short item"), (8, "short-item here"), (9, "a a a a a a a a a a a a"), (10, "word " * 5000 + PASSAGE), (11, "one two three four five six seven eight nine ten"), (12, "two three four five six seven eight nine ten"),
]
BENCH = [(1, PASSAGE), (2, "short item"), (10, "É été"), (3, None), (4, ""), (None, "word"), (5, "a a a a a a a a a a a"), (5, "ünder"), (6, PASSAGE), (2, "short item"), *((100 + k, f"filler {k}") for k in range(9))]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*c, "x", "y") for c in CASES], DOCS)
    items = spark.createDataFrame([(*b, "z") for b in BENCH], ITEMS)
    for chars, keep in ((8_000_000, 2), (60, 9), (25, 1)):  # in one block, in several, and in more than a worker keeps
        got = sorted(map(tuple, D.digest(D.hits(docs, items, block_chars=chars, keep=keep, buffer_words=2000)).collect()), key=str)
        assert got == brute(CASES, BENCH)
    assert len(D._write_index(docs, items, 10, 25)) >= 5


def test_spans_and_removal(spark):
    docs = spark.createDataFrame([(*c, "x", "y") for c in CASES], DOCS)
    items = spark.createDataFrame([(1, PASSAGE, "z")], ITEMS)
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in D.hits(docs, items).collect()}
    assert spans[1] == [(1, 13)] and spans[7] == [(0, 24)] and spans[2] == []
    left = D.remove_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(c[0]) for c in CASES if c[0] not in (1, 7, 10, 11))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert D.hits(docs, spark.createDataFrame([(1, "a", "")], ITEMS)).count() == 0
    some = spark.createDataFrame([(1, "Two words", "", "")], DOCS)
    assert D.digest(D.hits(some, items)).first()[:4] == (1, 2, 0, 0)
    assert D.remove_contaminated(some, items).count() == 1
