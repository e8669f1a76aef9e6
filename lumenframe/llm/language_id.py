"""Language of a text by cross-parsing entropy.

For each language a suffix automaton of some labelled texts, joined by spaces, accepts exactly the
substrings of that. A text is parsed greedily into longest matches: a phrase goes on while the automaton has a transition, and
the next one starts at the letter that had none. A letter that the language's text lacks, which no
phrase can hold, counts as two phrases. The fewer phrases, weighted by the bits that name a
place in the language's text, the better it predicts the text; the language with the fewest bits
wins, ties by more training rows, then by name.

Texts are lower-cased, and each run of other characters than letters and the marks on them counts as
one space; letters are their code points, of any script. Many texts are parsed at once. A long text
is parsed from the start of each ``BLOCK`` letters too: as a parse depends only on where a phrase
starts, each block's parse is followed into the next block until both start a phrase at one letter,
and from there on the next block's own parse counts. The result is that of one parse from the text's
first letter to its last.

Automata are built in tasks, a language each, from a bounded sample of labelled rows: of each language's
different texts of at most ``max_chars`` characters, in order of their hash, up to ``sample_docs`` whole
texts of ``sample_chars`` characters together, one at least; a language with longer texts only gives its
shortest. So each labelled language is learned. Transitions lie in one array a language (row
displacement), 8 bytes for each and a third more for the gaps: 32 texts of 2.5 KB take about 2 MB, so 200
such languages take 0.4 GB in each Python worker, and 1 GB if all are of ``sample_chars``.

Null texts and texts without a letter are ``und`` with score 0; without training rows so are all.
Repeated rows each get their result, further columns are ignored, an empty table gives no rows. A
very long text is a slice of its own, of some 40 bytes a letter.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import storage

BLOCK = 512
SPACE = 32
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of ``codes``: each state's transitions; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return moves


class Letters:
    """Which code points are letters, and which are letters or marks; made once a process."""

    _plane: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def plane(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls._plane is None:
            letter = np.array([chr(c).isalpha() for c in range(65536)])
            marked = letter | np.array([unicodedata.category(chr(c))[0] == "M" for c in range(65536)])
            cls._plane = letter, marked
        return cls._plane


def encode(text: str) -> tuple[np.ndarray, bool]:
    """Code points of a text's letters and single spaces, and whether it has a letter."""
    letter, marked = Letters.plane()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    low = np.minimum(points, 65535)
    keep, some = marked[low], bool(letter[low[points < 65536]].any())
    far = np.flatnonzero(points > 65535)
    if len(far):
        known = {c: (chr(c).isalpha(), unicodedata.category(chr(c))[0] == "M") for c in np.unique(points[far]).tolist()}
        keep[far] = [any(known[c]) for c in points[far].tolist()]
        some = some or any(k[0] for k in known.values())
    codes = np.where(keep, points, SPACE)
    stay = keep.copy()
    stay[1:] |= keep[:-1]
    return codes[stay], some


class Automaton:
    """A language's transitions in one array: that of state s (its base) with letter c stands at s + c.

    An entry holds the base of the state that owns it and of the one it leads to. The root's are a
    list of their own: from there each letter starts a phrase, as does one without a transition.
    """

    def __init__(self, codes: np.ndarray):
        moves = automaton(codes.tolist())
        self.letters = len(codes)
        self.top = int(codes.max(initial=SPACE)) + 1  # stands for every letter beyond
        base, entries = [0] * len(moves), {}
        used, first, taken = bytearray(1 << 16), {}, set()
        for s in sorted(range(1, len(moves)), key=lambda s: -len(moves[s])):
            own = sorted(moves[s])
            if not own:
                continue
            low, n = own[0], len(own)
            gaps = [c - low for c in own]
            at = used.find(0, max(first.get(n, 0), low))
            while True:
                while at < 0 or at + gaps[-1] >= len(used):
                    used += bytes(len(used))
                    at = used.find(0, max(first.get(n, 0), low) if at < 0 else at)
                if at - low not in taken and not any(used[at + g] for g in gaps):
                    break
                at = used.find(0, at + 1)
            base[s] = at - low
            taken.add(base[s])
            for c in own:
                used[base[s] + c] = 1
                entries[base[s] + c] = s, moves[s][c]
            first[n] = at
        size = max(entries, default=0) + 1
        self.root = size  # a base without entries
        ends = size
        for s in range(1, len(moves)):
            if not moves[s]:
                ends += 1
                base[s] = ends
        base[0] = self.root
        own, to = np.full(ends + self.top + 2, -1, np.int32), np.zeros(ends + self.top + 2, np.int32)
        for k, (s, t) in entries.items():
            own[k], to[k] = base[s], base[t]
        self.own, self.to = own, to
        self.start = np.full(self.top + 1, self.root, np.int32)
        for c, t in moves[0].items():
            self.start[c] = base[t]

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether each letter starts a phrase."""
        at = state + codes
        new = self.own[at] != state
        return np.where(new, self.start[codes], self.to[at]), new


class Blocks:
    """Encoded texts laid out in blocks: each text's blocks follow one another, its letters without a gap."""

    def __init__(self, coded: list[np.ndarray]):
        sizes = np.array([len(c) for c in coded], np.int64)
        self.blocks = -(-sizes // BLOCK)
        self.n = int(self.blocks.sum())
        self.flat = np.full(self.n * BLOCK, SPACE, np.int32)
        self.first = (np.cumsum(self.blocks) - self.blocks) * BLOCK
        for k, c in enumerate(coded):
            self.flat[self.first[k] : self.first[k] + len(c)] = c
        self.ends = self.first + sizes
        self.owner = np.repeat(np.arange(len(coded)), self.blocks)
        filled = np.minimum(self.ends[self.owner] - np.arange(self.n) * BLOCK, BLOCK)
        self.order = np.argsort(-filled, kind="stable")
        self.active = np.searchsorted(-filled[self.order], -np.arange(BLOCK), "left")  # blocks longer than t
        self.last = np.ones(self.n, bool)  # of its text
        self.last[:-1] = self.owner[1:] != self.owner[:-1]

    def phrases(self, a: Automaton) -> np.ndarray:
        """How many phrases each text has, letters that the automaton lacks counted twice."""
        flat = np.minimum(self.flat, a.top)
        columns = np.ascontiguousarray(flat.reshape(self.n, BLOCK)[self.order].T)
        state, starts = np.full(self.n, a.root, np.int32), np.zeros((BLOCK, self.n), bool)
        for t in range(BLOCK):
            m = self.active[t]
            if not m:
                break
            state[:m], starts[t, :m] = a.step(state[:m], columns[t, :m])
        back = np.empty_like(self.order)
        back[self.order] = np.arange(self.n)
        starts = np.ascontiguousarray(starts.T)[back].ravel()
        seen = np.concatenate([[0], np.cumsum(starts)])  # starts before each place
        out = np.bincount(self.owner, seen[BLOCK::BLOCK] - seen[:-1:BLOCK], len(self.blocks)).astype(np.int64)
        lacks = np.concatenate([[0], np.cumsum(a.start[flat] == a.root)])
        twice = lacks[self.ends] - lacks[self.first]
        run = np.flatnonzero(~self.last)
        if not len(run):
            return out + twice
        # each block's parse goes on in the next until both start a phrase at one letter, or the text ends
        meet, more = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        at, end, now = (run + 1) * BLOCK, self.ends[self.owner[run]], state[back[run]]
        while len(run):
            now, new = a.step(now, flat[at])
            met = new & starts[at]
            more[run] += new & ~met
            at = at + ~met
            done = met | (at >= end)
            meet[run[done]] = at[done]
            run, at, end, now = (x[~done] for x in (run, at, end, now))
        block = np.flatnonzero(~self.last)
        near = meet[block] <= (block + 2) * BLOCK
        for k in np.unique(self.owner[block[~near]]).tolist():  # a phrase longer than a block: follow the parse
            b, total = int(self.first[k]) // BLOCK, 0
            place, end = int(self.first[k]), int(self.ends[k])
            while place < end:
                upto = (place // BLOCK + 1) * BLOCK
                b = place // BLOCK
                total += int(seen[min(upto, self.n * BLOCK)] - seen[place])
                if self.last[b]:
                    break
                total += int(more[b])
                place = int(meet[b])
            out[k] = total
        usual = block[near & ~np.isin(self.owner[block], self.owner[block[~near]])]
        own = more[usual] - (seen[meet[usual]] - seen[(usual + 1) * BLOCK])
        return out + twice + np.bincount(self.owner[usual], own, len(self.blocks)).astype(np.int64)


class Parser:
    """Automata of all languages; languages with more training rows first."""

    def __init__(self, languages: list[str], automata: list[Automaton]):
        self.languages, self.automata = languages, automata
        self.bits = np.array([np.log2(a.letters + 2) for a in automata])

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) phrases, and whether each text has a letter."""
        coded = [encode(t or "") for t in texts]
        letters = np.array([some for _, some in coded], bool)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        blocks = Blocks([c for c, _ in coded])
        if blocks.n:
            for k, a in enumerate(self.automata):
                out[:, k] = blocks.phrases(a)
        return out, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages, and 1 minus the best's share of the second best's bits (1 if there is no second)."""
        found, letters = self.phrases(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = found * self.bits
        best = cost.argmin(axis=1)
        low = cost[np.arange(len(texts)), best]
        second = np.partition(cost, 1, axis=1)[:, 1] if len(self.languages) > 1 else np.full(len(texts), np.inf)
        score = np.where(letters, 1 - low / np.maximum(second, 1e-9), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.clip(score, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, sample_docs: int = 32, max_chars: int = 50_000, most_languages: int = 256) -> tuple[DataFrame, dict[str, int]]:
    """Training texts (lang, h, t) of each language, and its training rows.

    Equal texts are one text of the sample. All texts up to a hash that about twice ``sample_docs``
    of a language have are picked, and that of its lowest hash in any case. Texts of over ``max_chars``
    characters don't train unless a language has no shorter one. Of more than ``most_languages`` labels
    those with most training rows are learned, as every worker holds all automata; a row for each
    of them reaches the driver, and the limits are joined as a table of so many rows.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"), F.col("text").alias("t"), F.length("text").alias("size"))
    short = F.when(F.col("size") <= max_chars, F.col("h"))
    sums = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(short).alias("texts"), F.min(short).alias("low"), F.min(F.struct("size", "h")).alias("least"))
    limits, known = [], {}
    for r in sums.orderBy(F.desc("n"), "lang").limit(most_languages).collect():
        known[r["lang"]] = r["n"]
        if r["low"] is None:
            limits.append((r["lang"], r["least"]["h"], r["least"]["size"]))
        else:
            limit = (2**63 - 1) if r["texts"] <= 2 * sample_docs else max(r["low"], (2**63 - 1) // r["texts"] * 2 * sample_docs)
            limits.append((r["lang"], limit, max_chars))
    table = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, wanted long, most int"))
    picked = rows.join(table, "lang").where("h <= wanted AND size <= most")
    return picked.groupBy("lang", "h").agg(F.min("t").alias("t")), known


def fitting(texts: list[str], sample_docs: int, sample_chars: int) -> list[str]:
    """The first of ``texts``, and those after it while both bounds hold."""
    out, size = [], 0
    for t in texts[:sample_docs]:
        size += len(t)
        if out and size > sample_chars:
            break
        out.append(t)
    return out


def learn(docs: DataFrame, sample_docs: int = 32, sample_chars: int = 200_000, max_chars: int = 50_000, most_languages: int = 256) -> tuple[str, dict[str, int]]:
    """The stored automata of all languages, and the languages' training rows. A task builds a language's from its sample."""
    texts, rows = sample(docs, sample_docs, max_chars, most_languages)
    folder = storage.new_folder(docs.sparkSession, "languages")

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        some = fitting(group.sort_values(["h", "t"])["t"].tolist(), sample_docs, sample_chars)
        storage.put(f"{folder}/{key[0].encode().hex()}", pickle.dumps(Automaton(encode(" ".join(some))[0])))
        return pd.DataFrame({"lang": [key[0]]})

    known = {r["lang"] for r in texts.groupBy("lang").applyInPandas(build, "lang string").collect()} if rows else set()
    return folder, {k: n for k, n in rows.items() if k in known}


_parsers: dict[str, Parser] = {}


def _parser(folder: str, rows: dict[str, int]) -> Parser:
    """One parser for each worker process, read from the shared folder."""
    if folder not in _parsers:
        _parsers.clear()
        names, automata = sorted(rows, key=lambda x: (-rows[x], x)), []
        for name in names:
            store, path = storage.open_store(f"{folder}/{name.encode().hex()}")
            with store.open_input_stream(path, compression=None) as source:
                automata.append(pickle.loads(source.read()))
        _parsers[folder] = Parser(names, automata)
    return _parsers[folder]


def predict(docs: DataFrame, learned: tuple[str, dict[str, int]]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``, from its text alone."""
    folder, rows = learned

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(folder, rows)
        for batch in batches:
            for part in storage.by_size(batch, "text", 2_000_000):
                names, scores = parser.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    return storage.in_small_batches(docs.select(doc_id.alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")).mapInArrow(work, RESULT)


def identify(docs: DataFrame, sample_docs: int = 32, sample_chars: int = 200_000, max_chars: int = 50_000, most_languages: int = 256) -> DataFrame:
    """Learn from the training rows of ``docs`` and predict every row."""
    return predict(docs, learn(docs, sample_docs, sample_chars, max_chars, most_languages))
