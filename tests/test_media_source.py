import hashlib
import os

import pytest

from lumenframe.operators import ingest
from lumenframe.sources import media_source as M


@pytest.fixture()
def tree(tmp_path):
    files = {"a/x.jpg": b"one", "a/b/y.MP4": b"two", "a/b/c/z.png": b"", "a/.hidden/h.jpg": b"h", "a/.dot.jpg": b"d", "a/readme.txt": b"t", "q.jpeg": b"three", "a/b/same.jpg": b"one", "a/sp ace é.webm": b"four"}
    for name, data in files.items():
        path = tmp_path / "s1" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (tmp_path / "s2").mkdir()
    return tmp_path, {"s1": str(tmp_path / "s1"), "s2": f"file://{tmp_path}/s2", "gone": str(tmp_path / "none")}


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_walk(spark, tree, parts):
    top, sources = tree
    found = M.hashed(M.scan(spark, sources, parts=parts)).collect()
    got = {r["rel_path"]: (r["size_bytes"], r["kind"], r["media_id"]) for r in found if r["error"] is None}
    want = {"a/x.jpg": b"one", "a/b/y.MP4": b"two", "a/b/c/z.png": b"", "q.jpeg": b"three", "a/b/same.jpg": b"one", "a/sp ace é.webm": b"four"}
    assert got == {k: (len(v), "video" if k[-3:] in ("MP4", "ebm") else "image", hashlib.sha256(v).hexdigest()) for k, v in want.items()}
    assert all(r["mtime_ns"] == os.stat(r["path"]).st_mtime_ns for r in found if r["error"] is None)
    assert [(r["source_name"], r["rel_path"]) for r in found if r["error"]] == [("gone", ".")]
    assert M.scan(spark, sources, "video", parts).where("error is null").count() == 2


def test_errors_are_counted_and_keep_a_source_from_the_sweep(spark, tree, monkeypatch):
    top, sources = tree
    files = M.scan(spark, sources)
    os.remove(top / "s1" / "q.jpeg")  # goes between walk and reading
    listed = spark.createDataFrame([(*r,) for r in [("s1", str(top / "s1/q.jpeg"), "q.jpeg", 5, 1, "image", None), ("s1", str(top / "s1/a/x.jpg"), "a/x.jpg", 3, 1, "image", None)]], M.FILES)
    counts = M.error_counts(M.hashed(listed).unionByName(M.hashed(files).where("source_name != 's1'")), sources)
    assert {r["source_name"]: (r["n_files"], r["n_errors"]) for r in counts.collect()} == {"s1": (1, 1), "s2": (0, 0), "gone": (0, 1)}
    state = spark.createDataFrame([(s, "old.jpg", 1, 1, "m", 1, 1) for s in sources], "source_name string, rel_path string, size_bytes long, mtime_ns long, media_id string, last_seen_scan_id long, missing_since_scan_id long")
    marked = ingest.swept(state, 2, M.sound_sources(counts))
    assert {r["source_name"]: r["action"] for r in marked.collect()} == {"s1": "keep", "s2": "delete", "gone": "keep"}


def test_a_file_over_two_gigabytes(spark, tmp_path):
    path = tmp_path / "large.mp4"
    size = (2 << 30) + 5
    with open(path, "wb") as f:
        f.truncate(size)
    row = M.hashed(M.scan(spark, {"s": str(tmp_path)}), block=8 << 20).first()
    want, zeros, left = hashlib.sha256(), bytes(1 << 20), size
    while left:
        want.update(zeros[: min(left, len(zeros))])
        left -= min(left, len(zeros))
    assert (row["size_bytes"], row["media_id"], row["error"]) == (size, want.hexdigest(), None)


def test_canonical_content(spark, tree):
    top, sources = tree
    of = lambda b: hashlib.sha256(b).hexdigest()
    media = spark.createDataFrame([(of(b"one"), "s1", "a/x.jpg", 0), (of(b"old"), "s1", "q.jpeg", 0), (of(b"m"), "s1", "missing.jpg", 0), (of(b"d"), "s1", "missing.jpg", 1)], "media_id string, source_name string, rel_path string, deleted int")
    got = {r["media_id"]: (r["found_id"], r["error"] is None) for r in M.changed_content(media, {"s1": sources["s1"]}).collect()}
    assert got == {of(b"old"): (of(b"three"), True), of(b"m"): (None, False)}


def test_no_sources(spark):
    assert M.scan(spark, {}).count() == 0
