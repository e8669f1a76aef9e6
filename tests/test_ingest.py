"""Scans held against a brute force, with nulls and repeated rows, and what their plans read."""

from collections import Counter

import pytest

from lumenframe.operators import ingest

SNAP = "source_name string, rel_path string, size_bytes long, mtime_ns long, media_id string"
STATE = SNAP + ", last_seen_scan_id long, missing_since_scan_id long"
MEDIA = "media_id string, source_name string, rel_path string, deleted int, missing_since_scan_id long"

#: Files that are hit, touched, replaced, moved, copied, new, back and gone; rows that come twice, without a place, an id, a size or a state.
SNAPSHOT = [
    ("s", "hit", 1, 1, "A"), ("s", "hit", 1, 1, "A"), ("s", "touch", 1, 2, "B"), ("s", "repl", 2, 2, "N"), ("s", "two", 2, 2, "N"), ("s", "moved", 1, 1, "D"), ("s", "copy", 1, 1, "A"), ("s", "copy", 1, 1, "N"),
    ("s", "back", 1, 1, "G"), ("s", "swap1", 2, 2, "F"), ("s", "swap2", 2, 2, "E"), ("s", "no id", 1, 1, None), ("s", "id", 2, 2, None), ("s", "size", 1, 1, "I"), (None, "x", 1, 1, "A"), ("s", None, 1, 1, "J"), ("s", "odd", 1, 1, "K"), ("s", "apart", 3, 3, "Q"),
]
PRINTS = [
    ("s", "hit", 1, 1, "A", 1, None), ("s", "touch", 1, 1, "B", 1, None), ("s", "repl", 1, 1, "C", 1, None), ("s", "two", 1, 1, "C", 1, None), ("s", "two", 1, 1, "P", 1, 1), ("s", "old", 1, 1, "D", 1, 1), ("s", "swap1", 1, 1, "E", 1, None), ("s", "swap2", 1, 1, "F", 1, None),
    ("s", "no id", 1, 1, "H", 1, None), ("s", "id", 1, 1, "L", 1, None), ("s", "size", None, 1, "M", 1, None), (None, "x", 1, 1, "A", 1, 1), ("s", None, 1, 1, "O", 1, 1), ("s", "gone", 1, 1, "R", 1, 1), ("s", "gone", 1, 1, "R", 1, 1), ("s", "gone2", 1, 1, "S", 1, 1), ("s", "left", 1, 1, "S", 1, None), ("s", "lost", 1, 1, "T", 1, 1), ("s", "nobody", 1, 1, None, 1, 1), ("s", "apart", 1, 1, "U", 1, None),
]
KNOWN = [
    ("A", "s", "hit", 0, None), ("B", "s", "touch", 0, None), ("C", "s", "repl", 0, None), ("D", "s", "old", 0, 1), ("D", "s", "moved", 0, 1), ("E", "s", "swap1", 0, None), ("F", "s", "copy", 0, 1), ("G", "s", "back", 1, None), ("I", None, "size", 0, None), ("K", "s", "odd", None, None),
    ("L", "s", "id", 0, None), ("M", "s", "size", 0, None), ("O", "s", None, 0, 1), ("P", "s", "two", 1, None), ("R", "s", "gone", 0, 1), ("R", "s", "gone", 0, 1), ("S", "s", "gone2", 0, 1), ("T", "s", "lost", 1, 1), (None, "s", "nobody", 0, None), ("U", "s", "apart", 0, None),
]


def tables(spark):
    return spark.createDataFrame(SNAPSHOT, SNAP), spark.createDataFrame(PRINTS, STATE), spark.createDataFrame(KNOWN, MEDIA)


def stored(spark, folder):
    """The tables as files, for what a plan reads."""
    for name, rows in zip(("snapshot", "state", "media"), tables(spark), strict=True):
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return [spark.read.parquet(f"{folder}/{name}.parquet") for name in ("snapshot", "state", "media")]


def reads(df) -> int:
    """Leaves of the optimized plan."""
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def matching(rows, at, place):
    """Rows with these values, none of them null; a None if there is no such row."""
    return [r for r in rows if None not in place and at(r) == place] or [None]


def decided(verify=False):
    """(place, media_id, decision, replaced, old_id, grace_cleared) by loops, a row for each row of a left join."""
    for s in SNAPSHOT:
        for o in matching(PRINTS, lambda r: r[:2], s[:2]):
            for m in matching(KNOWN, lambda r: r[:1], s[4:5]):
                for h in matching(SNAPSHOT, lambda r: r[:2], m[1:3] if m else (None,)):
                    alike = bool(o) and s[4] is not None and o[4] == s[4]
                    same = bool(o) and s[2:4] == o[2:4] and (not verify or alike)
                    replaced = bool(o) and not same and o[4] is not None and s[4] is not None and not alike
                    known = m is not None and m[3] is not None
                    decision = "hit" if same else "refreshed" if alike else "new" if not known else "resurrected" if m[3] == 1 else "copy" if h and h[4] == s[4] else "move"
                    cleared = known and m[3] == 0 and m[4] is not None and decision not in ("hit", "refreshed")
                    yield s[:2], o[4] if same else s[4], decision, replaced, o[4] if replaced else None, cleared


@pytest.mark.parametrize("verify", [False, True])
def test_decisions_of_odd_rows(spark, verify):
    got = ingest.classify(*tables(spark), verify).collect()
    assert Counter(((r["source_name"], r["rel_path"]), r["media_id"], r["decision"], bool(r["replaced"]), r["old_id"], bool(r["grace_cleared"])) for r in got) == Counter(decided(verify))


def test_counters_of_odd_rows(spark):
    rows, live = [*decided()], {m[0] for m in KNOWN if m[3] == 0 and m[0] is not None}
    superseded = ({r[4] for r in rows} - {r[1] for r in rows}) & live
    unseen = [o for o in PRINTS if None in o[:2] or o[:2] not in {s[:2] for s in SNAPSHOT}]
    kept = {r[1] for r in rows} | {o[4] for o in unseen if o[6] is None}
    tombstoned = ({o[4] for o in unseen if o[6] is not None} - kept) & live
    kinds = Counter(r[2] for r in rows)
    want = {k: kinds[k] for k in ("hit", "refreshed", "new", "copy", "move", "resurrected")}
    want |= {"hashed": len(rows) - kinds["hit"], "changed": sum(r[3] for r in rows), "superseded": len(superseded), "tombstoned": len(tombstoned)}
    assert ingest.apply_scan(*tables(spark), 2)["counters"].first().asDict() == want and {"C", "U"} <= superseded and tombstoned == {"O", "R"}
    assert {r[0] for r in ingest.superseded(ingest.classify(*tables(spark)), tables(spark)[2]).collect()} == superseded


def test_counters_of_an_empty_scan(spark):
    snapshot, state, media = tables(spark)
    got = ingest.apply_scan(snapshot.where("false"), state, media, 2)["counters"].first().asDict()
    assert got["hashed"] == got["superseded"] == 0 and got["tombstoned"] == 3  # D, O and R


def test_counters_look_up_media_places_once(spark, tmp_path):
    """What is superseded and tombstoned comes from the files beside their prints, without the joins that only decisions need."""
    counters = ingest.apply_scan(*stored(spark, tmp_path), 2)["counters"]
    assert reads(counters) <= 13
    plan = counters._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter, ((canon_source") == 1


def test_superseded_reads_files_prints_and_media_once(spark, tmp_path):
    """Lost and held ids come from one reading, without the joins that only decisions need."""
    snapshot, state, media = stored(spark, tmp_path)
    found = ingest.superseded(ingest.classify(snapshot, state, media), media)
    assert reads(found) == 3 and "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_superseded_of_odd_decisions(spark):
    rows = [("N", True, "C"), ("N", True, "C"), ("N", None, "B"), ("A", False, "N"), (None, True, "D"), ("D", False, None), ("E", True, None), ("M", True, "A"), ("M", True, "X"), ("M", True, "P"), ("M", True, "Q")]
    decisions = spark.createDataFrame(rows, "media_id string, replaced boolean, old_id string")
    media = spark.createDataFrame([("C", 0), ("C", 0), ("B", 0), ("A", 0), ("D", 0), ("N", 0), ("P", 1), ("Q", None), (None, 0)], "media_id string, deleted int")
    assert [r[0] for r in ingest.superseded(decisions, media).collect()] == ["C"]  # A and D are held, X isn't known, P and Q aren't live
    assert ingest.superseded(decisions.where("false"), media).isEmpty()
