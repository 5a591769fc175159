"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints link at three or fewer differing bits. The 64 bits are three segments (23, 23 and 18
bits, the last padded with zeros). The binary Golay code (23, 12) is perfect: every 23-bit word lies
within three bits of one codeword, whose 12-bit index is the word's decoding. Two segments that
differ in at most one bit share a key when one gives its own decoding and the other gives the
decodings of itself and of its one-bit neighbours (one index, or six). Three errors leave either
a segment without error and another with at most one, or one error in each; so the keys are

* for each ordered pair of segments: the first whole, the second's indices;
* the indices of both long segments with one whole half of the short one.

Cases: a null or wordless text has fingerprint zero and links like any other; equal fingerprints are
one node; a null ``doc_id`` keeps its row and never names a component unless all ids are null (then
null); repeated rows each come out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import components, cut

WIDTHS = (23, 23, 18)
MAX_BITS = 3
#: Generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b110001110101
#: Words of one text that are hashed at a time.
PIECE = 200_000
#: Runs of equal keys up to this length are compared by shifted arrays, longer ones by search.
SHORT_RUN = 48


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None) -> int:
    """64-bit majority of the XXH64 (seed 42) of the 3-word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    xx = xxhash.xxh64_intdigest
    if len(words) < 3:
        return xx(b" ".join(words), 42)
    total, n = np.zeros(64, np.int64), len(words) - 2
    for k in range(0, n, PIECE):
        part = words[k : k + PIECE + 2]
        joined, size = b" ".join(part), np.fromiter(map(len, part), np.int64, len(part))
        ends = np.fromiter(accumulate(map(len, part)), np.int64, len(part)) + np.arange(len(part))
        starts = (ends - size)[:-2].tolist()
        total += bit_counts(np.array([xx(joined[a:b], 42) for a, b in zip(starts, ends[2:].tolist(), strict=True)], np.uint64))
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [fingerprint(x) for x in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id BIGINT, fp BIGINT")


def _syndrome_of(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


class Golay:
    """Decoding tables: syndromes by byte and the error of each syndrome."""

    def __init__(self) -> None:
        single = np.array([_syndrome_of(1 << i) for i in range(24)], np.uint32)
        values = np.arange(256)
        self.by_byte = [np.bitwise_xor.reduce(np.where(values[:, None] >> np.arange(8) & 1, single[8 * k : 8 * k + 8], 0), axis=1).astype(np.uint32) for k in range(3)]
        self.error = np.zeros(2048, np.uint32)
        bits = [(1 << i, int(single[i])) for i in range(23)] + [(0, 0)]
        for i, (a, x) in enumerate(bits):
            for j, (b, y) in enumerate(bits[i:], i):
                for c, z in bits[j:]:
                    if (a == b and a) or (b == c and b):
                        continue
                    self.error[x ^ y ^ z] = a ^ b ^ c

    def decode(self, v: np.ndarray) -> np.ndarray:
        """Index of the codeword within three bits of each 23-bit word."""
        s = self.by_byte[0][v & 255] ^ self.by_byte[1][v >> 8 & 255] ^ self.by_byte[2][v >> 16 & 255]
        return (v ^ self.error[s]) >> 11

    def keys(self, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, 6) indices of each word and its one-bit neighbours, own first, and which are distinct."""
        own = self.decode(v)
        near = np.sort(self.decode(v[:, None] ^ np.left_shift(np.uint32(1), np.arange(width, dtype=np.uint32))[None, :]), axis=1)
        fresh = near != own[:, None]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        out, valid = np.zeros((len(v), 6), np.uint32), np.zeros((len(v), 6), bool)
        out[:, 0], valid[:, 0] = own, True
        row, col = np.nonzero(fresh)
        place = np.cumsum(fresh, axis=1)[row, col]
        out[row, place], valid[row, place] = near[row, col], True
        return out, valid


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def search_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the fingerprints: (key, position in ``fp``, whether it is made of own decodings)."""
    code, seg = golay(), []
    for shift, width in zip((0, 23, 46), WIDTHS, strict=True):
        seg.append((fp >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.uint32))
    near = [code.keys(v, w) for v, w in zip(seg, WIDTHS, strict=True)]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for tag, (i, j) in enumerate([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]):
        keys, valid = near[j]
        row, col = np.nonzero(valid)
        out.append((np.int64(tag) << 56 | seg[i][row].astype(np.int64) << 12 | keys[row, col], row, col == 0))
    (ka, va), (kb, vb) = near[0], near[1]
    row, x, y = np.nonzero(va[:, :, None] & vb[:, None, :])
    both = ka[row, x].astype(np.int64) << 12 | kb[row, y]
    for tag, half in ((6, seg[2] & 511), (7, seg[2] >> 9)):
        out.append((np.int64(tag) << 56 | half[row].astype(np.int64) << 24 | both, row, (x == 0) & (y == 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(fp), 20_000):
            key, row, own = search_keys(part := fp[k : k + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64)), pa.array(own)], ["key", "fp", "own"])


def forest(fp: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join every pair of the distinct fingerprints within reach, without listing all pairs."""
    a, b, left = [], [], fp
    while left.size:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            p = todo.pop()
            hit = np.bitwise_count(left ^ p) <= MAX_BITS
            if hit.any():
                found = left[hit]
                a += [int(p)] * len(found)
                b += found.tolist()
                todo += list(found)
                left = left[~hit]
    return a, b


def _links(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key; all rows of a key are there."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    useful = (size > 1) & np.logical_or.reduceat(own, start)
    a, b = [], []
    short = np.repeat(useful & (size <= SHORT_RUN), size)
    k, f = key[short], fp[short]
    for d in range(1, int(size[useful & (size <= SHORT_RUN)].max(initial=1))):
        hit = (k[d:] == k[:-d]) & (f[d:] != f[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= MAX_BITS)
        a.append(f[:-d][hit])
        b.append(f[d:][hit])
    for i in np.flatnonzero(useful & (size > SHORT_RUN)):
        x, y = forest(np.unique(fp[start[i] : start[i] + size[i]]))
        a.append(np.array(x, np.uint64))
        b.append(np.array(y, np.uint64))
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]

    def out(parts):
        x, y = _links(*parts)
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64))], ["a", "b"])

    for batch in batches:
        new = [batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("own").to_numpy(zero_copy_only=False)]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if whole:
            yield out([x[:whole] for x in held])
            held = [x[whole:] for x in held]
    if len(held[0]):
        yield out(held)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column ``fp``; they connect all within reach."""
    keys = prints.select("fp").distinct().mapInArrow(_emit_keys, "key BIGINT, fp BIGINT, own BOOLEAN")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a BIGINT, b BIGINT")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    prints = cut(fingerprints(docs))
    groups = components(links(prints)).withColumnsRenamed({"node": "fp", "component": "root"})
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = cut(least.join(groups, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(named, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one that names it; all columns kept. Rows without doc_id stay."""
    gone = near_duplicates(docs).filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("bigint") == F.col("_gone"), "left_anti")
