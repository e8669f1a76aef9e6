import io
import random
import zlib

import numpy as np

from lumenframe.llm import dac, packing, storage, token_files, tokens

ODD = ["", None, "a<|endoftext|>b", "it's 're don't''s \"'s x's's 'st", "ÀÉ×÷ß ²½ 12.5%", "ΣΑΣ 漢字 ﬁ", "donaudampfschifffahrtsgesellschaft " * 3, "!" * 40, "'", " ' 's", "tab\tnew\nline\r\x0b\x0c\x85\xa0x", "é é", "\x01 \x00 s"]


def library(texts):
    t = tokens.BatchTokenizer(tokens.default_path()).library
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_ids_equal_the_library(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abAB'.,! é9\n-") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    encoder = tokens.BatchTokenizer(tokens.default_path(), max_words=50)
    for some in (texts, texts[::-1], [], [None]):
        ids, lengths = encoder.encode(some)
        want = library(some)
        assert ids.tolist() == sum(want, []) and lengths.tolist() == [len(w) for w in want]


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.choice([0, 255, 256, 49407, 65535, 65536, 2**32 - 1], n).astype(np.uint32)
        reader = dac.Reader(io.BytesIO(dac.pack([None, 7], np.array([n // 2, n]), ids)))
        assert reader.all().tolist() == ids.tolist()
        assert [reader.token(i) for i in range(0, n, 37)] == ids[::37].tolist()
        names, ends = reader.documents()
        assert names == [None, 7] and ends.tolist() == [n // 2, n]


def test_files_round_trip(spark):
    rows = [(5, "five words are in here", 1), (None, "no id", 2), (2, None, 3), (9, "", 4), (5, "a second five", 5), (1, "x " * 30000, 6), (3, ODD[5], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    manifest = token_files.write(docs, storage.new_folder(spark, "t"), tokens_per_file=1000)
    got = token_files.read(spark, manifest).orderBy("start").collect()
    code = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, code[r[1]]))
    at = 0
    for r, (doc, text, _) in zip(got, order, strict=True):
        ids = library([text])[0]
        assert tuple(r) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sum(m["n_tokens"] for m in manifest) == at
    assert token_files.read(spark, token_files.write(docs.limit(0), storage.new_folder(spark, "t"))).count() == 0


def test_packing_loses_nothing(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(300)]
    rows = [(k, " ".join(rng.choice(words[k % 3 * 100 : k % 3 * 100 + 100]) for _ in range(rng.randint(0, 500))), "x") for k in range(80)]
    rows += [(100, None, ""), (101, "", ""), (None, "no id", ""), (7, "again", ""), (102, "long " * 9000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    pieces = packing.pack(docs, shard_tokens=20_000).toPandas()
    ids = {}
    for doc, text, _ in rows:
        ids.setdefault(doc, []).append(library([text])[0])
    got = {}
    for r in pieces.sort_values("start").itertuples():
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        got.setdefault(None if r.doc_id != r.doc_id else int(r.doc_id), []).extend(r.ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(sum(v, [])) for k, v in ids.items()}
    assert all(got[k] == v[0] for k, v in ids.items() if len(v) == 1)
    short = 0
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]]
        assert s.length.sum() <= packing.WINDOW
        short += s.length.sum() < packing.WINDOW
    assert short <= 4  # one for each partition at most
    assert packing.pack(docs.limit(0)).count() == 0


def test_other_vocabularies_go_whole_to_the_library(tmp_path):
    import json

    told = json.load(open(tokens.default_path()))
    told["normalizer"]["normalizers"].pop()  # no lower case
    path = tmp_path / tokens.WORD_BPE
    path.write_text(json.dumps(told))
    encoder = tokens.BatchTokenizer(str(path))
    assert not encoder.by_word and tokens.BatchTokenizer(tokens.default_path()).by_word
    want = encoder.library.encode("A dog's 2 Houses", add_special_tokens=False).ids
    assert encoder.encode(["A dog's 2 Houses"])[0].tolist() == [*want, 1]


def test_repeats_of_a_row_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 10_000)  # as many partitions as a large table has
    docs = spark.createDataFrame([(7, "the same few words", "x")] * 4000, "doc_id long, text string, sequence_id string")
    manifest = token_files.write(docs, storage.new_folder(spark, "t"))
    assert len({m["part"] for m in manifest}) > 2 and sum(m["n_docs"] for m in manifest) == 4000
    pieces = packing.pack(docs)
    assert pieces.selectExpr("sequence_id >> 40 part").distinct().count() > 2 and pieces.agg({"length": "sum"}).first()[0] == 4000 * len(library(["the same few words"])[0])


def test_windows_fill_with_the_best_neighbours():
    """Each window against BM25 scores of its seed taken term by term."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(2, 60, int(rng.integers(40, 900))).astype(np.int32) for _ in range(60)]
    packer = packing._Packer(0)
    for k, d in enumerate(docs):
        packer.add(k, d)
    packer.pack(True)
    got = {}
    for doc, start, length, _, _, seq, offset, _ in packer.rows:
        got.setdefault(seq, []).append((offset, doc, start, length))
    mean, n = np.mean([len(d) for d in docs]), len(docs)
    df = {t: sum(t in d for d in docs) for t in range(60)}

    def bm25(seed, other):
        out = 0.0
        for t in set(seed.tolist()):
            tf = int((other == t).sum())
            out += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(other) / mean)) if tf else 0.0
        return out

    left = {k: len(d) for k, d in enumerate(docs)}
    first = {k: rank for rank, k in enumerate(sorted(left, key=lambda k: (-left[k], k)))}
    for seq in sorted(got):
        pieces = sorted(got[seq])
        seed = min((k for k in left if left[k]), key=first.get)
        assert pieces[0][1] == seed
        order = sorted((k for k in left if left[k] and k != seed), key=lambda k: (-round(bm25(docs[seed], docs[k]), 9), k))
        want, room = [seed], packing.WINDOW - left[seed]
        for k in order:
            if room <= 0:
                break
            want.append(k)
            room -= left[k]
        assert [p[1] for p in pieces] == want
        for _, k, _, length in pieces:
            left[k] -= length
    assert not any(left.values())


def test_neighbours_share_terms():
    a, b, c = np.array([1, 2, 3, 4]), np.array([3, 4, 5, 3]), np.array([7, 8])
    scores = packing.Index([a, b, c]).scores(0)
    assert scores[0] > scores[1] > scores[2] == 0


def test_best_pieces_equal_a_full_sort():
    rng = np.random.default_rng(2)
    for size in (0, 1, 5, 50, 400):
        pieces = np.sort(rng.choice(1000, size, replace=False))
        score = rng.integers(0, 4, size).astype(float)
        for n in (1, 3, 100):
            assert packing._best(pieces, score, n).tolist() == pieces[np.lexsort((pieces, -score))][:n].tolist()


def test_many_tiny_documents_pack_fast():
    packer = packing._Packer(0)
    for k in range(30_000):
        packer.add(k, np.array([k % 500 + 2, 1], np.int32))
    packer.pack(True)
    assert sum(r[2] for r in packer.rows) == 60_000 and packer.sequence == 30
