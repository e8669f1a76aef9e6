import math
import random
import re
import zlib

import numpy as np
import pytest

from lumenframe.llm import language_id as L
from lumenframe.llm import quality_classifier as C
from lumenframe.llm import quality_rules as R


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at, hit = {}, set()
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    for v in at.values():
        if len(v) > 1:
            for i in v:
                hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)]


def texts():
    rng = random.Random(2)
    out = ["", None, "a " * 50, " x\n x\n\x0b\n", "é ü # $ x", "w " * 8, "a b c d e f g h i a b c d e f g h", "漢字 " * 30, "one\r\ntwo\r\none\r\n"]
    return out + [" ".join(rng.choice(["a", "bé", "c#", "d\n", "e"]) for _ in range(rng.randint(0, 200))) for _ in range(150)]


def test_measures_equal_brute_force(spark):
    rows = [(k, t, "s", "q", 1.0, 2) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, host_rate double, n_words int")
    for with_text in (True, False):
        judged = R.judge(docs, with_text=with_text)
        assert ("text" in judged.columns) == with_text
        got = {r["doc_id"]: r for r in judged.collect()}
        for k, t, *_ in rows:
            m = measures(t)
            failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
            assert [got[k][c] for c in R.MEASURES] == m and got[k]["base_failed"] == failed and (failed <= (not got[k]["kept"]))


def test_hosts(spark):
    good, bad = " ".join(f"w{k}" for k in range(40)), "too short"
    rows = [(k, bad, "spam") for k in range(60)] + [(100, good, "spam"), (101, good, None), (102, bad, None)]
    rows += [(200 + k, good if k % 10 else bad, f"h{k % 20}") for k in range(400)] + [(700, bad, "one")]
    found = {r["doc_id"]: r for r in R.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found[100]["host_rejected"] and not found[100]["kept"] and not found[100]["base_failed"]
    assert found[101]["kept"] and found[101]["host_rate"] is None and not found[102]["kept"]
    assert found[201]["kept"] and not found[700]["host_rejected"]  # one failure rejects no host
    assert R.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_prior():
    mean, weight = R.beta_prior(1000.0, 100.0, 10 * 100.0**2, sum((10 * x) ** 2 / 100 for x in range(0, 3)) * 10 / 3, 10)
    assert mean == pytest.approx(0.1) and 1 <= weight <= 1e6
    assert R.beta_prior(None, None, None, None, 0) == (0.0, 1.0)


TONGUES = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "der schnelle braune fuchs springt", "cc": "žluťoučký kůň příliš úpěl ódy"}


def tongue_rows():
    rng = random.Random(4)
    out = []
    for k in range(240):
        lang = list(TONGUES)[k % 3]
        out.append((k, " ".join(rng.choice(TONGUES[lang].split()) for _ in range(rng.randint(3, 60))), lang, "s"))
    return out


def test_languages(spark):
    rows = tongue_rows() + [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, "12 -- 34", "cc", "s"), (903, "漢字", None, "s"), (None, "lorem ipsum", None, "s"), (5, "lorem", "aa", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for d, _, lang, _ in rows[:240]:
        assert by[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= by[d]["score"] <= 1
        if d != 5:
            assert by[d]["lang_pred"] == lang
    assert [by[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and by[903]["lang_pred"] in TONGUES
    assert L.identify(docs.limit(0)).count() == 0
    assert L.identify(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).where("lang_pred != 'und'").count() == 0


def phrases(codes, known):
    """Greedy longest matches of ``codes`` in ``known``, letter by letter; a letter that isn't there counts twice."""
    text, i, n = "".join(map(chr, codes)), 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        n += 1 if text[i] in known else 2
        i = max(i + 1, j - 1)
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(1)
    known = [L.encode(t)[0] for t in [*TONGUES.values(), "".join(rng.choice("abcd ") for _ in range(2000)) + " " + "q" * 1500, "".join(map(chr, range(0x4E00, 0x5200)))]]
    parser = L.Parser([str(k) for k in range(len(known))], [L.Automaton(k) for k in known])
    texts = ["lorem fuchs", "x" * 1200, "der braune dolor " * 100, "ž", "", None, "ipsum! LOREM", "q\U00010400\U0001f600", "q" * 1400, "q" * 4000 + "a", "a" * 512, "a" * 513, "漢字" * 700, "".join(map(chr, range(0x4E80, 0x5100)))]
    texts += ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 3000))) for _ in range(12)]
    found, letters = parser.phrases(texts)
    for k, codes in enumerate(known):
        text = "".join(map(chr, codes))
        assert found[:, k].tolist() == [phrases(L.encode(t or "")[0], text) for t in texts]
    assert letters.tolist()[:8] == [True, True, True, True, False, False, True, True]


def test_predictions_equal_brute_force(spark):
    rows = [(d, t, lang) for d, t, lang, _ in tongue_rows()][:90] + [(900, "lorem fuchs kůň", None), (901, "x" * 700 + " der dolor", None)]
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    trained = [(d, t, lang) for d, t, lang in rows if lang and zlib.crc32(str(d).encode()) % 4 != 2]
    folder, counts = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    known = {}
    for name in TONGUES:
        texts = {t for _, t, lang in trained if lang == name}
        assert counts[name] == sum(lang == name for *_, lang in trained) and len(texts) <= 32
        order = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "shiftrightunsigned(xxhash64(t), 1) h").orderBy("h").collect()
        known[name] = "".join(map(chr, L.encode(" ".join(r["t"] for r in order))[0]))
    for d, text, _ in rows:
        codes = L.encode(text)[0]
        cost = sorted((phrases(codes, k) * math.log2(len(k) + 2), -counts[n], n) for n, k in known.items())
        assert got[d] == (cost[0][2], round(1 - cost[0][0] / cost[1][0], 9))


def test_no_language_is_lost(spark):
    rows = [(k, f"salve amice {k} carissime", "la") for k in range(300)] + [(1000 + k, "der schnelle braune fuchs", "de") for k in range(2000)] + [(9000, "ένα δύο τρία", "el"), (9001, "ένα δύο τρία", "el")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, counts = L.learn(docs, sample_docs=4)
    assert set(counts) == {"la", "de", "el"}
    got = L.identify(docs, sample_docs=4).groupBy("lang_pred").count().collect()
    assert {tuple(r) for r in got} == {("la", 300), ("de", 2000), ("el", 2)}


def test_the_sample_is_bounded_by_whole_texts(spark):
    assert L.fitting(["aaaa", "bb", "ccc"], 9, 6) == ["aaaa", "bb"] and L.fitting(["aaaa", "bb"], 1, 9) == ["aaaa"] and L.fitting(["aaaa", "b"], 9, 2) == ["aaaa"]
    rows = [(k, "kurz " * n, "de") for k, n in enumerate((3, 4, 900))] + [(k, "longus " * n, "la") for k, n in ((10, 800), (11, 500))] + [(20, "x y", None)]
    texts, counts = L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("crc32(cast(doc_id as string)) % 4 != 2"), max_chars=100)
    assert {(r["lang"], len(r["t"])) for r in texts.collect()} <= {("de", 15), ("de", 20), ("la", 3500), ("la", 5600)} and set(counts) == {"de", "la"}
    assert sum(r["lang"] == "la" for r in texts.collect()) == 1


def test_large_alphabets_stay_apart(spark):
    rng = random.Random(7)
    sets = {"one": range(0x4E00, 0x53DC), "two": range(0x6000, 0x65DC)}  # 1,500 letters each
    rows = [(k, "".join(chr(rng.choice(sets[("one", "two")[k % 2]])) for _ in range(60)), ("one", "two")[k % 2]) for k in range(400)]
    found = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by = {d: lang for d, _, lang in rows}
    assert sum(r["lang_pred"] == by[r["doc_id"]] for r in found) >= 395


def test_whole_texts_decide(spark):
    rows = [(k, t, lang) for k, t, lang, _ in tongue_rows()]
    long = "lorem ipsum dolor " * 30 + "der schnelle braune fuchs springt " * 60_000  # 2 MB
    got = L.identify(spark.createDataFrame([*rows, (5000, long, None)], "doc_id long, text string, lang string")).where("doc_id = 5000").first()
    assert got["lang_pred"] == "bb"


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for k in range(300):
        n = rng.randint(60, 400)
        text = ". ".join(word() for _ in range(n)) if k % 3 else [" ".join([word()] * n), " ".join(word() + "###" for _ in range(n)), " ".join(word().upper() + "!!" for _ in range(n))][k // 3 % 3]
        rows.append((k, text, "x"))
        labels.append((k, int(k % 3 > 0)))
    rows += [(900, None, ""), (901, "", ""), (None, "some words", ""), (5, "again", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (901, None), (77777, 0)], "doc_id long, quality int")
    got = C.score(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    known = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in known and r["doc_id"] != 5]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) / len(held) > 0.9
    assert {r["score"] for r in C.score(docs, marks.limit(0)).collect()} == {0.5}
    assert C.score(docs.limit(0), marks).count() == 0


def test_scores_equal_the_densities(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(("w%d" % rng.randint(0, 30) + "#" * (k % 2 * rng.randint(0, 3))) for _ in range(rng.randint(30, 90)))) for k in range(160)]
    labels = [(k, 1 - k % 2) for k, _ in rows if k % 4 < 3] + [(3, 1)]  # a document with two labels counts twice
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in C.score(docs, marks, shrinkage=0.1).collect()}
    x = {k: np.round(np.log(C.statistics_of(t.encode())), C.DIGITS) for k, t in rows}
    train = {c: np.array([x[k] for k, q in labels if q == c and zlib.crc32(str(k).encode()) % 5]) for c in (0, 1)}
    total = sum(map(len, train.values()))
    cov = {c: np.cov(t.T, bias=True) for c, t in train.items()}
    unit = np.sqrt(np.maximum(sum(len(t) * np.diag(cov[c]) for c, t in train.items()) / total, 1e-9))
    for k, t in rows:
        log = {}
        for c, own in train.items():
            s = cov[c] / np.outer(unit, unit)
            s = 0.9 * s + (0.1 * np.trace(s) / len(s) + 1e-6) * np.eye(len(s))
            z = (x[k] - own.mean(axis=0)) / unit
            log[c] = math.log(len(own) / total) - 0.5 * (z @ np.linalg.solve(s, z) + np.linalg.slogdet(s)[1])
        assert got[k] == pytest.approx(1 / (1 + math.exp(log[0] - log[1])), abs=1e-9)
    assert got == {r["doc_id"]: r["score"] for r in C.score(docs.repartition(7), marks.repartition(3), shrinkage=0.1).collect()}
