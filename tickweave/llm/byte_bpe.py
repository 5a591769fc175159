"""Byte-level BPE encoding and decoding on padded numpy matrices.

Distinct pattern matches are put in rows by length; each round every row merges its leftmost pair of
lowest rank, looked up in a hash table over token pairs, and finished rows leave the matrix.

Cases: a null or empty text has no tokens; special-token strings are ordinary text; repeated rows
and other columns do not matter; an empty table gives no rows; a text of any length is worked through
in pieces, and one match of any length is merged with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest match that goes through the matrices.
MATRIX = 256
#: Cached matches of a worker; the cache starts anew beyond it.
CACHE = 300_000
#: Matches that are resolved together, and characters after which a text is worked through in pieces.
TOGETHER, LONG = 250_000, 2_000_000
NONE = np.int32(2**31 - 1)


class Encoder:
    """Encodes by the ranks of a file; ``pattern`` splits the text first."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.token[i] = t
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        pairs = {}
        for t, i in self.ranks.items():
            for k in range(1, len(t)):
                if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None:
                    pairs[a << 32 | b] = i
        self._table(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, NONE, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while left.size:
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[left][free], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, NONE where it does not merge or a side is padding (-1)."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64) & np.uint64(2**32 - 1)
        keys = np.where((a < 0) | (b < 0), np.uint64(2**64 - 2), keys)
        slot = self._slot(keys)
        out, found = self.values[slot], self.keys[slot]
        out = np.where(found == keys, out, NONE)
        todo = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while todo.size:
            slot[todo] = slot[todo] + 1 & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))]
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        n, out = len(pieces), [b""] * len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, pieces), np.int64, n)
        col = np.arange(width)
        ids = np.where(col[None, :] < size[:, None], self.byte[raw], np.int32(-1))
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rows = np.arange(n)
        while rows.size:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                for r, x, k in zip(rows[done].tolist(), ids[done], size[done].tolist(), strict=True):
                    out[r] = x[:k].astype("<u4").tobytes()
                keep = ~done
                rows, at, best, size = rows[keep], at[keep], best[keep], size[keep]
                w = max(2, int(size.max(initial=0)))
                ids, ranks = ids[keep][:, :w], ranks[keep][:, : w - 1]
                if not rows.size:
                    break
            w, line = ids.shape[1], np.arange(len(rows))
            moved = np.arange(w)[None, :] + (np.arange(w)[None, :] > at[:, None])
            padded = np.concatenate([ids, np.full((len(rows), 1), -1, np.int32)], axis=1)
            ids = np.take_along_axis(padded, moved, axis=1)
            ids[line, at] = best
            size = size - 1
            padded = np.concatenate([ranks, np.full((len(rows), 1), NONE, np.int32)], axis=1)
            ranks = np.take_along_axis(padded, moved[:, : w - 1], axis=1)
            right = at < w - 1
            ranks[line[right], at[right]] = self.rank(ids[line[right], at[right]], ids[line[right], at[right] + 1])
            left = at > 0
            ranks[line[left], at[left] - 1] = self.rank(ids[line[left], at[left] - 1], ids[line[left], at[left]])
        return out

    def _heap(self, piece: bytes) -> bytes:
        """The same merges for one long match: lowest rank first, leftmost among equals."""
        ids, n = [int(self.byte[x]) for x in piece], len(piece)
        after, before, text = list(range(1, n + 1)), list(range(-1, n - 1)), [bytes([x]) for x in piece]
        heap = [(r, i, text[i], text[i + 1]) for i in range(n - 1) if (r := self.ranks.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or text[i] != a or text[j] != b:
                continue
            text[i], ids[i], ids[j], after[i] = a + b, r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (q := self.ranks.get(text[x] + text[after[x]])) is not None:
                    heapq.heappush(heap, (q, x, text[x], text[after[x]]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each match as little-endian 32-bit integers."""
        out: list[bytes | None] = [np.array([r], "<u4").tobytes() if (r := self.ranks.get(p)) is not None else None for p in pieces]
        groups: dict[int, list[int]] = {}
        for i, x in enumerate(out):
            if x is None:
                n = len(pieces[i])
                groups.setdefault(0 if n > MATRIX else 1 << (n - 1).bit_length(), []).append(i)
        for width, rows in groups.items():
            step = max(1, 2_000_000 // max(1, width))
            for k in range(0, len(rows), step):
                part = [pieces[i] for i in rows[k : k + step]]
                for i, x in zip(rows[k : k + step], self._matrix(part, width) if width else map(self._heap, part), strict=True):
                    out[i] = x
        return out

    def _learn(self, pieces: set[str]) -> None:
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = [p for p in pieces if p not in self.cache]
        self.cache.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))

    def encode_texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; texts are resolved together up to a number of matches."""
        held: list[list[str]] = []
        count = 0
        for text in texts:
            if text and len(text) > LONG:
                yield from self._flush(held)
                held, count = [], 0
                yield self._long(text)
                continue
            held.append(self.pattern.findall(text) if text else [])
            count += len(held[-1])
            if count > TOGETHER:
                yield from self._flush(held)
                held, count = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[str]]) -> Iterator[bytes]:
        self._learn(set().union(*held))
        got = self.cache.__getitem__
        for pieces in held:
            yield b"".join(map(got, pieces))

    def _long(self, text: str) -> bytes:
        found, out = self.pattern.finditer(text), []
        while part := [m.group() for m in islice(found, TOGETHER)]:
            out += self._flush([part])
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, *, digest: bool = False, checked: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids or the digests of ids and of the decoded bytes).

    ``checked`` decodes the ids too and adds ``round_trip``: whether the bytes are those of the text (none for a null).
    """
    default = _files()
    path, pattern = path or default[0], pattern or default[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                n, first, second = [], [], []
                texts = part.column("text").to_pylist()
                for text, ids in zip(texts, enc.encode_texts(texts), strict=True):
                    n.append(len(ids) // 4)
                    if digest:
                        first.append(hashlib.sha256(ids).hexdigest())
                        second.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                    else:
                        first.append(ids)
                        if checked:
                            second.append(enc.decode(ids) == (text or "").encode())
                if digest:
                    cols = [pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    lists = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in first], pa.list_(pa.int32()))
                    flag = {"round_trip": pa.array(second, pa.bool_())} if checked else {}
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), lists, *flag.values()], ["doc_id", "n_tokens", "ids", *flag])

    kind = "ids_sha256 STRING, decoded_sha256 STRING" if digest else "ids ARRAY<INT>" + (", round_trip BOOLEAN" if checked else "")
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, f"doc_id BIGINT, n_tokens BIGINT, {kind}")


def query(docs: DataFrame) -> DataFrame:
    return encode(docs, digest=True)
