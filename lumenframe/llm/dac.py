"""Directly addressable codes: a file format for token ids with random access to any of them.

Each id is cut into chunks of ``CHUNK_BITS`` bits, lowest first. Level k holds the k-th chunk of
every id that has one, a bitmap with a 1 for each chunk that another follows, and a rank directory
(how many ones stand before each block of ``RANK_BLOCK`` bits). The chunk of id i at the next level
stands where the ones before i count to, so one id is read in as many steps as it has chunks and
nothing else is decoded.

Layout, little-endian: magic, version and counts; (offset, entries) of each level; the documents'
ids, null flags and end offsets; then for each level codes, bitmap and directory.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"LFDAC001"
CHUNK_BITS = 8
RANK_BLOCK = 512
HEAD = struct.Struct("<8sIIQQ")  # magic, chunk bits, levels, ids, documents
LEVEL = struct.Struct("<QQ")  # offset in the file, entries


def pack(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of some documents: their ids, where each ends among ``ids``, and the token ids."""
    levels, rest = [], ids.view(np.uint32) if ids.itemsize == 4 else ids.astype(np.uint32)
    while True:
        codes = rest.astype(np.uint8).tobytes()  # the lowest chunk
        goes_on = rest >= 1 << CHUNK_BITS
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, RANK_BLOCK // 64).sum(axis=1)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint64)
        levels.append((len(rest), [codes, bits.tobytes(), directory.tobytes()]))
        rest = rest[goes_on] >> np.uint32(CHUNK_BITS)
        if not len(rest):
            break
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = HEAD.pack(MAGIC, CHUNK_BITS, len(levels), len(ids), len(doc_ids))
    docs = np.array([d or 0 for d in doc_ids], np.int64).tobytes() + known.tobytes() + np.asarray(ends, np.int64).tobytes()
    at, table = len(head) + LEVEL.size * len(levels) + len(docs), b""
    for n, data in levels:
        table += LEVEL.pack(at, n)
        at += sum(map(len, data))
    return b"".join([head, table, docs, *(part for _, data in levels for part in data)])


class Reader:
    """Reads from ``source`` (a seekable binary file) only what a call needs."""

    def __init__(self, source):
        self.source = source
        magic, bits, levels, self.n_ids, self.n_docs = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC or bits != CHUNK_BITS:
            raise ValueError("not a file of directly addressable codes")
        table = self._read(HEAD.size, LEVEL.size * levels)
        self.levels = [LEVEL.unpack_from(table, LEVEL.size * k) for k in range(levels)]
        self._docs = HEAD.size + LEVEL.size * levels

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        data, n = self._read(self._docs, 17 * self.n_docs), self.n_docs
        ids, known = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.uint8, n, 8 * n)
        return [d if k else None for d, k in zip(ids.tolist(), known, strict=True)], np.frombuffer(data, np.int64, n, 9 * n)

    def _parts(self, k: int) -> tuple[int, int, int, int]:
        """Entries of a level, and where its codes, bitmap and directory start."""
        at, n = self.levels[k]
        blocks = -(-n // RANK_BLOCK)
        return n, at, at + n, at + n + blocks * (RANK_BLOCK // 8)

    def token(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k in range(len(self.levels)):
            _, codes, bitmap, directory = self._parts(k)
            value |= self._read(codes + i, 1)[0] << (CHUNK_BITS * k)
            block, inside = divmod(i, RANK_BLOCK)
            bits = int.from_bytes(self._read(bitmap + block * (RANK_BLOCK // 8), RANK_BLOCK // 8), "little")
            if not bits >> inside & 1:
                break
            i = int.from_bytes(self._read(directory + 8 * block, 8), "little") + (bits & ((1 << inside) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, as unsigned 32-bit integers."""
        out, there = np.zeros(self.n_ids, np.uint32), np.ones(self.n_ids, bool)
        for k in range(len(self.levels)):
            n, codes, bitmap, directory = self._parts(k)
            out[there] |= np.frombuffer(self._read(codes, n), np.uint8).astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            there[there] = np.unpackbits(np.frombuffer(self._read(bitmap, directory - bitmap), np.uint8), count=n, bitorder="little").view(bool)
        return out
