"""Token ids of whole texts, from a vocabulary file of the ``tokenizers`` library."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Vocabulary file of the contract's queries; any other path is a parameter.
WORD_BPE = "word_bpe_49k.json"
END_ID = 1
#: Latin-1 bytes whose lower case and pre-token class are known here; texts of others go to the library whole.
PLAIN = bytes([9, 10, 13, *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
#: Contractions are pre-tokens of their own where no punctuation stands before them (fixed values of the vocabulary's
#: pre-tokenizer); one byte stands for each.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
#: The normalizer and pre-tokenizer that splitting words here stands for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
CONTRACTION = re.compile(rb"(?<![!-/:-@\[-`{-~])'(?:s|t|re|ve|m|ll|d)")
AS_BYTE = {c.encode(): bytes([32, k + 1, 32]) for k, c in enumerate(CONTRACTIONS)}
LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else 32 if c in (9, 10, 13) else c for c in range(256))
#: 0 space, 1 letter, 2 digit, 3 punctuation, 4 contraction; after lower-casing.
KIND = bytes(0 if c == 32 else 2 if 48 <= c <= 57 else 1 if 97 <= c <= 122 or c >= 0xDF else 4 if 1 <= c <= 7 else 3 for c in range(256))
ROOM = 16  # bytes of a word that its key holds


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


class WordTable:
    """Rows of known words by their bytes: an open-addressed table of 16-byte keys, looked up in whole arrays."""

    def __init__(self, slots: int = 1 << 16):
        self.rows = np.full(slots, -1, np.int32)
        self.low, self.high = np.zeros(slots // 2, np.uint64), np.zeros(slots // 2, np.uint64)
        self.n = 0

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(len(self.rows) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is unknown."""
        slot = self._slot(low, high)
        out = self.rows[slot]
        left = np.flatnonzero((out >= 0) & ((self.low[out] != low) | (self.high[out] != high)))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.rows) - 1)
            out[left] = row = self.rows[slot[left]]
            left = left[(row >= 0) & ((self.low[row] != low[left]) | (self.high[row] != high[left]))]
        return out

    def _place(self, rows: np.ndarray) -> None:
        slot = self._slot(self.low[rows], self.high[rows])
        while len(rows):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = rows[free]
            left = self.rows[slot] != rows
            rows, slot = rows[left], (slot[left] + 1) & (len(self.rows) - 1)

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        """Further distinct keys, in rows from ``n`` on."""
        first, self.n = self.n, self.n + len(low)
        grown = False
        while 2 * self.n > len(self.rows):
            self.rows = np.full(2 * len(self.rows), -1, np.int32)
            self.low, self.high = (np.concatenate([x, np.zeros_like(x)]) for x in (self.low, self.high))
            grown = True
        self.low[first : self.n], self.high[first : self.n] = low, high
        self._place(np.arange(0 if grown else first, self.n, dtype=np.int32))


class BatchTokenizer:
    """Encodes lists of texts with ``tokenizer_path``; every text ends with ``END_ID``.

    The vocabulary splits lower-cased text at word borders before its merges, so equal pre-tokens
    have equal ids wherever they stand. Texts of plain Latin-1 characters are split here, and each
    distinct pre-token goes to the library once; any other text, and any vocabulary whose file names
    another normalizer or pre-tokenizer, goes to the library whole. The table of known words is emptied at ``max_words``,
    which bounds memory and changes no result.
    """

    def __init__(self, tokenizer_path: str, max_words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path)
        told = json.loads(self.library.to_str())
        splits = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        bytes_only = len(splits) == 2 and splits[1].get("type") == "ByteLevel" and not splits[1].get("add_prefix_space") and not splits[1].get("use_regex")
        self.by_word = told["normalizer"] == NORMALIZER and splits[0] == SPLIT and bytes_only and told["model"].get("end_of_word_suffix") == "</w>"
        self.max_words = max_words
        if self.by_word:
            vocab = self.library.get_vocab(with_added_tokens=True)
            self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
            self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.table = WordTable()
        self.long: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.bounds = np.zeros(1 << 14, np.int64)
        self.n_rows = 0
        self.row_of = np.zeros(0, np.int64)  # of the table's rows

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, and the end of each among them."""
        ids = np.asarray(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):  # not one word each after all
            found = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
            ids, ends = np.asarray([i for x in found for i in x], np.int32), np.cumsum([len(x) for x in found])
        return ids, ends

    def _learn(self, words: list[bytes]) -> None:
        texts = [CONTRACTIONS[w[0] - 1] if w[0] < 8 else w.decode("latin-1") for w in words]
        apart = [k for k, t in enumerate(texts) if "'" in t]  # these could join their neighbours
        rest = [k for k, t in enumerate(texts) if "'" not in t]
        sizes, pieces = np.zeros(len(words), np.int64), {}
        for some in [rest, *([k] for k in apart)]:
            if some:
                ids, ends = self._encode_words([texts[k] for k in some])
                sizes[some] = np.diff(ends, prepend=0)
                pieces |= {some[0]: ids} if len(some) == 1 else dict(zip(some, np.split(ids, ends[:-1]), strict=True))
        ids = np.concatenate([pieces[k] for k in range(len(words))])
        at, n = int(self.bounds[self.n_rows]), self.n_rows
        while n + len(words) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[at : at + len(ids)] = ids
        self.bounds[n + 1 : n + len(words) + 1] = at + np.cumsum(sizes)
        self.n_rows += len(words)

    def _rows(self, raw: bytes, kinds: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The row in ``bounds`` of each word of ``raw``."""
        at = np.ndarray(len(raw) - 15, "<u8", raw, strides=(1,))
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        short = np.array([(1 << 8 * k) - 1 for k in range(8)] + [full] * 9, np.uint64)
        inside = np.minimum(sizes, ROOM)
        low = at[starts] & short[inside]
        high = at[starts + 8] & short[np.maximum(inside - 8, 0)]
        high[inside <= 8] = 0
        found = self.table.find(low, high)
        large = np.flatnonzero(sizes > ROOM)
        found[large] = 0
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            own = order[first]
            rows = self.n_rows + np.arange(len(own))
            self._learn([raw[a : a + n] for a, n in zip(starts[own].tolist(), sizes[own].tolist(), strict=True)])
            self.table.add(low[own], high[own])
            self.row_of = np.concatenate([self.row_of, rows])
            found[new] = self.table.find(low[new], high[new])
        rows = self.row_of[found] if len(self.row_of) else found.astype(np.int64)
        for k in large.tolist():
            word = raw[starts[k] : starts[k] + sizes[k]]
            if word not in self.long:
                self.long[word] = self.n_rows
                self._learn([word])
            rows[k] = self.long[word]
        return rows

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has (its end id included)."""
        if self.n_rows > self.max_words:
            self._reset()
        raws, odd = [], {}
        for k, text in enumerate(texts):
            raw = b""
            if text:
                plain = self.by_word and "<|" not in text
                try:
                    raw = text.encode("latin-1") if plain else b""
                    plain = plain and not raw.translate(None, PLAIN)
                except UnicodeEncodeError:
                    plain = False
                if not plain:
                    odd[k], raw = np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.int32), b""
            raw = raw.translate(LOWER)
            raws.append(CONTRACTION.sub(lambda m: AS_BYTE[m[0]], raw) if b"'" in raw else raw)
        ids, ends = np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if any(raws):
            raw = b" ".join([*raws, b" " * 2 * ROOM])
            kinds = np.frombuffer(raw.translate(KIND), np.uint8)
            cuts = np.flatnonzero((kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)) + 1
            cuts = np.concatenate([[0], cuts, [len(raw)]])
            word = kinds[cuts[:-1]] != 0
            starts, sizes = cuts[:-1][word], np.diff(cuts)[word]
            rows = self._rows(raw, kinds, starts, sizes)
            first = self.bounds[rows]
            sizes = self.bounds[rows + 1] - first
            upto = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.flat[np.repeat(first - upto[:-1], sizes) + np.arange(upto[-1])]
            text_ends = np.cumsum([len(x) + 1 for x in raws])
            ends = upto[np.searchsorted(starts, text_ends)]
        lengths = np.diff(ends, prepend=0)
        if odd:
            parts, at = [], 0
            for k in range(len(texts)):
                parts.append(odd[k] if k in odd else ids[at : ends[k]])
                at = ends[k]
                lengths[k] = len(parts[-1])
            ids = np.concatenate(parts)
            ends = np.cumsum(lengths)
        return np.insert(ids, ends, END_ID), lengths + 1


_made: dict[str, BatchTokenizer] = {}


def tokenizer(path: str) -> BatchTokenizer:
    """One tokenizer for each worker process and path."""
    if path not in _made:
        _made[path] = BatchTokenizer(path)
    return _made[path]


def slices(texts: list[str | None], chars: int = 1_000_000):
    """(from, to) of consecutive texts of about ``chars`` characters together."""
    at = total = 0
    for k, text in enumerate(texts):
        total += len(text or "")
        if total >= chars:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(texts):
        yield at, len(texts)
