"""Periodic runs of words, found by matching aligned power-of-two blocks.

A run is a stretch of consecutive words with smallest period q, at least ``max(MIN_WORDS, 2 * q)`` words
long, that no neighbouring word extends. The part of a run that its own shift by q covers has at least
``max(q, MIN_WORDS - q)`` words, so it holds a whole block of ``b`` words that starts at a multiple of
``b``, for the largest power of two with ``2 * b - 1`` words or fewer. Each scale ``b`` thus stands for some
periods (``periods``), and at each scale the aligned blocks go into an automaton over word numbers, which
finds every place of every block in the text. Two places whose distance is one of the scale's periods
seed a stretch, which is extended word by word both ways until it ends.

What keeps this near linear: words that occur once end all runs, so only the stretches between them are
searched; a block of 2b words is tried only if both its halves were found twice; a seed inside a stretch
of its own distance is that stretch; and a block that is itself periodic lies in a run of an earlier
scale, as do all its places, so the ends of the two runs say where equality ends, without reading the
words between. Nothing is cut off: all runs of all texts are found.

Null and empty texts have no words and no runs. Repeated rows are judged row by row. Nothing is shuffled
or broadcast; a task holds one text at a time, some 100 bytes a word. Further columns of ``docs`` stay
unless they are named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm import storage

MIN_WORDS = 12
#: Seeds handled at a time, which bounds memory in texts that are periodic throughout.
SEEDS = 1_000_000
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
RESULTS = ["n_words", "runs", "collapsed"]


def periods(b: int) -> list[tuple[int, int]]:
    """The ranges of periods (first, last) whose runs hold an aligned block of ``b`` words but none of ``2 * b``."""
    low, high = 2 * b - 1, 4 * b - 2  # words that a run's shift covers at least
    out = [(max(1, MIN_WORDS - high), min(MIN_WORDS // 2 - 1, MIN_WORDS - low)), (max(low, (MIN_WORDS + 1) // 2), high)]
    return [(a, z) for a, z in out if a <= z]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """What stands between words that occur once, where it is long enough for a run."""
    once = np.flatnonzero(np.bincount(ids)[ids] == 1)
    edges = np.concatenate([[-1], once, [len(ids)]])
    long = np.flatnonzero(np.diff(edges) > MIN_WORDS)
    return [(int(edges[k]) + 1, int(edges[k + 1])) for k in long]


class _Text:
    """The runs of one text, given as word numbers."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.parts = np.array(stretches(ids), np.int64).reshape(-1, 2)
        #: at each place, the number of the block of this scale's half that stands there; 0 for none
        self.names = np.zeros(len(ids), np.int64)
        for a, z in self.parts.tolist():
            self.names[a:z] = ids[a:z] + 1
        self.found: dict[tuple[int, int], int] = {}  # (start, end): period
        self.known = np.zeros((0, 3), np.int64)  # (start, end, period) of earlier scales, by start

    def places(self, blocks: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Where any of the blocks (by their first words) stands, and the number of the block that stands there."""
        number: dict[tuple[int, int], int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key in zip(self.names[blocks].tolist(), self.names[blocks + half].tolist(), strict=True):
            if key not in number:
                number[key] = len(number)
                automaton.add_word(key, number[key])
        automaton.make_automaton()
        # halves that follow each other stand next to each other here; a 0 ends what can't go on
        rows = -(-len(self.names) // half) + 1
        order = np.arange(rows * half).reshape(rows, half).T.ravel()
        names = np.concatenate([self.names, np.zeros(rows * half - len(self.names), np.int64)])[order]
        used = names > 0
        used[1:] |= used[:-1]
        order, names = order[used], names[used]
        hits = np.fromiter(chain.from_iterable(automaton.iter(tuple(names.tolist()))), np.int64).reshape(-1, 2)
        return order[hits[:, 0] - 1], hits[:, 1]

    def end_of_match(self, i: int, q: int, limit: int) -> int:
        """The first place from ``i`` on that differs from the one q later, at most ``limit - q``."""
        step, ids = 16, self.ids
        while i < limit - q:
            n = min(step, limit - q - i)
            differs = ids[i : i + n] != ids[i + q : i + q + n]
            if differs.any():
                return i + int(differs.argmax())
            i, step = i + n, step * 2
        return limit - q

    def start_of_match(self, i: int, q: int, limit: int) -> int:
        """The last place up to ``i`` from which on all places down to i equal those q later, at least ``limit``."""
        step, ids = 16, self.ids
        while i > limit:
            n = min(step, i - limit)
            differs = ids[i - n : i] != ids[i - n + q : i + q]
            if differs.any():
                return i - int(differs[::-1].argmax())
            i, step = i - n, step * 2
        return limit

    def keep(self, start: int, end: int, q: int) -> None:
        if end - start >= max(MIN_WORDS, 2 * q):
            self.found[start, end] = min(q, self.found.get((start, end), q))

    def extend(self, seeds: np.ndarray) -> None:
        """The stretches of seeds (distance, place, first and last word of the part), each once."""
        last, upto = 0, 0
        for q, s, first, end in seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))].tolist():
            if q == last and s < upto:
                continue
            start = self.start_of_match(s, q, first)
            last, upto = q, self.end_of_match(s, q, end)
            self.keep(start, upto + q, q)

    def run_around(self, at: np.ndarray, b: int, runs: np.ndarray) -> np.ndarray:
        """The number of the run, of those given, that holds ``b`` words from each place; -1 for none."""
        if not len(runs):
            return np.full(len(at), -1)
        k = np.searchsorted(runs[:, 0], at, "right") - 1
        return np.where((k >= 0) & (runs[k, 1] >= at + b), k, -1)

    def scale(self, b: int) -> bool:
        """Finds the runs of the periods of one scale; False if no block of it can occur twice."""
        own = np.arange(0, len(self.ids) - b + 1, b)
        own = own[(self.names[own] > 0) & (self.names[own + b // 2] > 0)]
        if not len(own):
            return False
        at, which = self.places(own, b // 2)
        order = np.lexsort((at, which))
        at, which = at[order], which[order]
        again = np.bincount(which)[which] > 1
        at, which = at[again], which[again]
        self.names = np.zeros(len(self.ids), np.int64)
        self.names[at] = which + 1
        own = own[self.names[own] > 0]
        kind, part = self.names[own] - 1, np.searchsorted(self.parts[:, 0], own, "right") - 1
        #: runs whose period goes twice into a block: no two of them share b words
        small = self.known[(self.known[:, 2] * 2 <= b) & (self.known[:, 1] - self.known[:, 0] >= b)]
        wide = len(self.ids) + 1
        code = which * wide + at
        for low, high in periods(b):
            a = np.searchsorted(code, kind * wide + own + low)
            z = np.searchsorted(code, kind * wide + np.minimum(own + high, self.parts[part, 1] - b), "right")
            n = np.maximum(z - a, 0)
            total = np.cumsum(n)
            cuts = np.unique([0, *np.searchsorted(total, np.arange(SEEDS, n.sum(), SEEDS)), len(n)])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                m = n[i:j]
                if not m.sum():
                    continue
                block = np.repeat(np.arange(i, j), m)
                to = at[np.repeat(a[i:j] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))]
                self.seeded(own[block], to, b, self.parts[part[block]], small)
        return True

    def seeded(self, s: np.ndarray, to: np.ndarray, b: int, part: np.ndarray, small: np.ndarray) -> None:
        """Extends the seeds at ``s`` and ``to``; those in runs of a small period only where the ends of two runs meet."""
        q = to - s
        if not len(small):
            self.extend(np.column_stack([q, s, part]))
            return
        left, right = self.run_around(s, b, small), self.run_around(to, b, small)
        both = (left >= 0) & (right >= 0)
        one, two = small[left], small[right]
        meets = (one[:, 0] + q == two[:, 0]) | (one[:, 1] + q == two[:, 1])
        apart = both & (left != right) & ~meets
        if apart.any():
            start = np.maximum(one[apart, 0], two[apart, 0] - q[apart])
            end = np.minimum(one[apart, 1] + q[apart], two[apart, 1])
            long = end - start >= np.maximum(MIN_WORDS, 2 * q[apart])
            for x, y, p in zip(start[long].tolist(), end[long].tolist(), q[apart][long].tolist(), strict=True):
                self.keep(x, y, p)
        rest = ~both | (left != right) & meets
        if rest.any():
            self.extend(np.column_stack([q[rest], s[rest], part[rest]]))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start and period."""
        b = 2
        while self.scale(b):
            b *= 2
            self.known = np.array(sorted((s, e, q) for (s, e), q in self.found.items()), np.int64).reshape(-1, 3)
        return sorted((s, e - s, q) for (s, e), q in self.found.items())


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of some words as (start, length, period)."""
    if len(words) < MIN_WORDS:
        return []
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return _Text(np.fromiter(map(number.__getitem__, words), np.int64, len(words))).runs()


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def find(docs: DataFrame) -> DataFrame:
    """``docs`` without their texts, with n_words, runs (by start, then period) and collapsed, the text of the words kept."""
    kept = [c for c in docs.columns if c not in ["text", *RESULTS]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in storage.by_size(batch, "text"):
                n, runs, texts = [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    words = (text or b"").split()
                    found = runs_of(words)
                    n.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    texts.append(b" ".join(collapse(words, found)))
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(1, part.num_columns)), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=[*(f"c{k}" for k in range(len(kept))), *RESULTS])

    plain = docs.select("text", *(F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(kept)))
    schema = T.StructType([*plain.drop("text").schema, T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    found = storage.in_small_batches(plain).mapInArrow(work, schema)
    return found.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)), *RESULTS)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run with its exponent, and SHA-256 of the runs' list and of the collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.withColumn("top", top)
    length, start, period = F.col("top.length"), -F.col("top.start"), -F.col("top.period")
    milli = F.expr("(1000 * top.length) div (-top.period)")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
