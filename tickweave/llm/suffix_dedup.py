"""Removal of repeated 100-byte strings by a hash-compared suffix sort.

A byte goes when a 100-byte string over it also starts earlier: in a smaller doc_id, or earlier in the
same text. Every such string (window) has an anchor: its 32-byte gram of least hash. Equal windows have
equal anchors at the same place, so only occurrences of repeated anchors need comparing:

1. each text is cut in blocks, the runs of windows that share an anchor; blocks are grouped by anchor
   and content (two independent 64-bit polynomial hashes). All but the first of equal blocks go whole;
2. where an anchor has differing blocks, their first occurrences are fetched, and their windows are sorted
   as suffixes (but those whose hash stands once, which equal no other): a merge sort whose comparisons find the common extension of two suffixes by binary
   search over prefix polynomial hashes. Equal neighbours are verified byte by byte; all but the first go;
3. the windows found are joined to the texts, which lose the bytes that any of them covers.

Equal blocks of one batch are reduced before the shuffle, so a group of copies of any size reaches a
task once per batch.

Cases: a null text counts as empty; texts under 100 bytes stay whole; rows without doc_id stay
whole and are compared with nothing; repeated rows with one doc_id and text are one document and come
out alike; different texts of one doc_id are documents of their own, in order of their hashes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import cut, marked, maybe_in

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes of text hashed together; a longer text is a batch of its own.
TOGETHER = 2_000_000
BLOCK = np.dtype([("h", "<u8"), ("f", "<u8"), ("doc", "<i8"), ("ver", "<u4"), ("lo", "<i4"), ("off", "u1"), ("more", "u1")])
HIT = np.dtype([("lo", "<i4"), ("hi", "<i4")])
ASK = np.dtype([("h", "<u8"), ("lo", "<i4"), ("off", "u1"), ("more", "u1")])
CONTEXT = np.dtype([("h", "<u8"), ("doc", "<i8"), ("ver", "<u4"), ("lo", "<i4"), ("off", "u1"), ("more", "u1")])
_rng = np.random.default_rng(20240229)
#: Random value of each byte and odd base, for two hash families.
VALUES = _rng.integers(1, 2**64, (2, 256), dtype=np.uint64)
BASES = _rng.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(family: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if family not in _powers or len(_powers[family][0]) < n:
        size, base = max(n, TOGETHER + LENGTH), int(BASES[family])
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[family] = tuple(both)
    return _powers[family]


class Prefix:
    """Prefix polynomial hashes (mod 2^64) of a buffer; the hash of any substring in a few steps."""

    def __init__(self, buf: np.ndarray, family: int) -> None:
        up, self.down = _power(family, len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(VALUES[family][buf] * up[: len(buf)], out=self.sums[1:])

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    return h ^ h >> np.uint64(29)


def blocks(docs: np.ndarray, vers: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """BLOCK records of the texts, which come in order of their ids and versions, in order of place."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size) - size
    if not (size >= LENGTH).any():
        return np.zeros(0, BLOCK)
    bits = max(1, int(len(buf)).bit_length())
    place = np.uint64((1 << bits) - 1)
    gram = Prefix(buf, 0)
    n = len(buf) - GRAM + 1
    h = _mix((gram.sums[GRAM:] - gram.sums[:-GRAM]) * gram.down[:n])
    low = h & ~place | np.arange(n, dtype=np.uint64)
    reach = 1
    while reach * 2 <= SPAN:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(low) - (SPAN - reach)], low[SPAN - reach :])
    inside = np.zeros(len(low) + 1, np.int8)
    long = size >= LENGTH
    inside[start[long]] = 1
    ends = (start + size - LENGTH + 1)[long]
    np.subtract.at(inside, ends, 1)
    valid = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    anchor = (low[valid] & place).astype(np.int64)
    first = np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)]
    lo, hi, a = valid[first], valid[np.r_[first[1:], True]], anchor[first]
    out = np.zeros(len(lo), BLOCK)
    text = np.searchsorted(start, lo, side="right") - 1
    empty = size[text] == 0
    while empty.any():  # texts of no bytes share a start with the next
        text[empty] += 1
        empty = size[text] == 0
    out["h"], out["doc"], out["ver"], out["lo"], out["off"], out["more"] = h[a], docs[text], vers[text], lo - start[text], a - lo, hi - lo
    shape = ((a - lo) * 128 + (hi - lo)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out["f"] = _mix(Prefix(buf, 1).at(lo, hi - lo + LENGTH) ^ shape)
    return out


def _packed(records: np.ndarray, order: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary array with the bytes of consecutive records from each start to the next."""
    data = np.ascontiguousarray(records[order])
    offsets = np.r_[starts, len(order)].astype(np.int64) * records.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _by(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, the last one first to count, and where a new value begins in it."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


FLOW = "bucket INT, kind INT, doc_id BIGINT, ver BIGINT, data BINARY"


def _rows(bucket: np.ndarray, kind: int, data: pa.Array, doc: np.ndarray | None = None, ver: np.ndarray | None = None) -> pa.RecordBatch:
    none = np.zeros(len(bucket), np.int64)
    cols = [pa.array(bucket.astype(np.int32)), pa.array(np.full(len(bucket), kind, np.int32)), *(pa.array(none if x is None else x.astype(np.int64)) for x in (doc, ver)), data]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "kind", "doc_id", "ver", "data"])


def _of_texts(kind: int, x: np.ndarray, rec: np.ndarray) -> pa.RecordBatch:
    """One row per text with its part of ``rec``; x names the texts."""
    order, starts = _by(x["ver"], x["doc"])
    first = x[order[starts]]
    return _rows(first["doc"] & 0x7FFF, kind, _packed(rec, order, starts), first["doc"], first["ver"])


def _hits(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    rec = np.zeros(len(lo), HIT)
    rec["lo"], rec["hi"] = lo, hi
    return _of_texts(1, x, rec)


def _elsewhere(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x["doc"] != y["doc"]) | (x["ver"] != y["ver"]) | (x["lo"] != y["lo"])


def _scan(buckets: int):
    def flush(ids: list[tuple[int, int]], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(ids)), key=ids.__getitem__)
        named = np.array([ids[i] for i in order], np.int64).reshape(-1, 2)
        found = blocks(named[:, 0], named[:, 1], [texts[i] for i in order])
        if not len(found):
            return
        _, first, group = np.unique(found["h"] * np.uint64(0x9E3779B97F4A7C15) ^ found["f"], return_index=True, return_inverse=True)
        again = _elsewhere(found[first[group]], found)
        if again.any():
            x = found[again]
            yield _hits(x, x["lo"], x["lo"] + x["more"])
        x = found[first]
        bucket = (x["h"] % np.uint64(buckets)).astype(np.int64)
        order, starts = _by(bucket)
        yield _rows(bucket[order[starts]], 0, _packed(x, order, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in batches:
            for d, v, t in zip(b.column("doc_id").to_pylist(), b.column("ver").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if t is None or len(t) < LENGTH:
                    continue
                if size + len(t) > TOGETHER and ids:
                    yield from flush(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append((d, v))
                texts.append(t)
                size += len(t)
        if ids:
            yield from flush(ids, texts)

    return run


def _each_bucket(batches: Iterator[pa.RecordBatch], other: list[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Data of one bucket after another; rows of kind 1 are put aside."""
    now, held = None, []
    for b in batches:
        kinds = b.column("kind").to_numpy()
        if (kinds == 1).any():
            other.append(b.filter(pa.array(kinds == 1)))
        part = b.filter(pa.array(kinds != 1))
        for k, data in zip(part.column("bucket").to_pylist(), part.column("data").to_pylist(), strict=True):
            if k != now and held:
                yield held
                held = []
            now = k
            held.append(data)
    if held:
        yield held


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal blocks of a bucket: all but the first go; blocks that differ round one anchor are asked for."""
    other: list[pa.RecordBatch] = []
    for held in _each_bucket(batches, other):
        yield from other
        other.clear()
        x = np.frombuffer(b"".join(held), BLOCK)
        x = x[np.lexsort((x["lo"], x["ver"], x["doc"], x["f"], x["h"]))]
        new_h = np.r_[True, x["h"][1:] != x["h"][:-1]]
        new = new_h | np.r_[True, x["f"][1:] != x["f"][:-1]]
        head = x[np.flatnonzero(new)[np.cumsum(new) - 1]]
        again = _elsewhere(head, x)
        if again.any():
            y = x[again]
            yield _hits(y, y["lo"], y["lo"] + y["more"])
        many = np.bincount(np.cumsum(new_h) - 1, new)[np.cumsum(new_h) - 1] > 1
        y = x[new & many]
        if len(y):
            rec = np.zeros(len(y), ASK)
            for c in ASK.names:
                rec[c] = y[c]
            yield _of_texts(2, y, rec)
    yield from other


def _fetch(buckets: int):
    """The bytes of the asked blocks, by bucket of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head, body = [], []
            for d, v, t, asked in zip(b.column("doc_id").to_pylist(), b.column("ver").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("data").to_pylist(), strict=True):
                rec = np.frombuffer(b"".join(asked), ASK)
                c = np.zeros(len(rec), CONTEXT)
                for name in ASK.names:
                    c[name] = rec[name]
                c["doc"], c["ver"] = d, v
                head.append(c)
                body += [t[a : a + m + LENGTH] for a, m in zip(rec["lo"].tolist(), rec["more"].tolist(), strict=True)]
            if not head:
                continue
            c = np.concatenate(head)
            bucket = (c["h"] % np.uint64(buckets)).astype(np.int64)
            order, starts = _by(bucket)
            ends = [*starts[1:].tolist(), len(order)]
            data = [int(e - s).to_bytes(8, "little") + c[order[s:e]].tobytes() + b"".join(body[i] for i in order[s:e]) for s, e in zip(starts.tolist(), ends, strict=True)]
            yield _rows(bucket[order[starts]], 2, pa.array(data, pa.binary()))

    return run


class Suffixes:
    """Suffixes of a buffer, compared up to LENGTH bytes by common extensions."""

    def __init__(self, buf: np.ndarray) -> None:
        self.buf, self.prefix = buf, Prefix(buf, 0)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low = np.full(len(a), LENGTH)
        apart = np.flatnonzero(self.prefix.at(a, LENGTH) != self.prefix.at(b, LENGTH))
        a, b = a[apart], b[apart]
        least, most = np.zeros(len(apart), np.int64), np.full(len(apart), LENGTH - 1)
        while (least < most).any():
            mid = (least + most + 1) // 2
            same = self.prefix.at(a, mid) == self.prefix.at(b, mid)
            least, most = np.where(same, mid, least), np.where(same, most, mid - 1)
        low[apart] = least
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b; equal ones by place."""
        e = self.extension(a, b)
        part = np.minimum(e, LENGTH - 1)
        x, y = self.buf[a + part], self.buf[b + part]
        return np.where(e == LENGTH, a < b, x < y)

    def sort(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """``at`` with every run of equal ``segment`` sorted: a merge sort of all runs at once."""
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        size = np.diff(np.r_[first, len(at)])
        base, total = np.repeat(first, size), np.repeat(size, size)
        place, width = np.arange(len(at)) - base, 1
        while width < size.max(initial=0):
            run = place // width
            start = (run ^ 1) * width
            low = np.minimum(start, total)
            begin, high = low.copy(), np.minimum(start + width, total)
            todo = np.flatnonzero(low < high)
            while todo.size:
                mid = (low[todo] + high[todo]) // 2
                less = self.before(at[base[todo] + mid], at[todo])
                low[todo], high[todo] = np.where(less, mid + 1, low[todo]), np.where(less, high[todo], mid)
                todo = todo[low[todo] < high[todo]]
            moved = base + (run // 2) * 2 * width + (place - run * width) + (low - begin)
            out = np.empty_like(at)
            out[moved] = at
            at, width = out, width * 2
        return at

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Byte-by-byte check of the strings at a and b."""
        out = np.zeros(len(a), bool)
        for k in range(0, len(a), 50_000):
            span = np.arange(LENGTH)[None, :]
            out[k : k + 50_000] = (self.buf[a[k : k + 50_000, None] + span] == self.buf[b[k : k + 50_000, None] + span]).all(axis=1)
        return out


def _met(hashes: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places whose key and hash stand elsewhere too, by key; the others equal no string, so the sort can do without them."""
    both = _mix(hashes) ^ key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    by = np.argsort(both)
    new = np.r_[True, both[by[1:]] != both[by[:-1]], True]
    by = np.sort(by[~(new[:-1] & new[1:])])
    return by[np.argsort(key[by], kind="stable")]


def repeated_windows(c: np.ndarray, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(record, window of the record) of the windows that an earlier record has too.

    Records come with their bytes; they are put in order of place, so a smaller position in the
    buffer is an earlier place.
    """
    size = c["more"].astype(np.int64) + LENGTH
    start = np.cumsum(size) - size
    order = np.lexsort((c["lo"], c["ver"], c["doc"]))
    buf = np.frombuffer(b"".join(body[start[i] : start[i] + size[i]] for i in order.tolist()), np.uint8)
    c, size = c[order], size[order]
    start = np.cumsum(size) - size
    count = c["more"].astype(np.int64) + 1
    rec = np.repeat(np.arange(len(c)), count)
    t = np.arange(len(rec)) - np.repeat(np.cumsum(count) - count, count)
    group = np.unique(c["h"], return_inverse=True)[1]
    key = group[rec] * 128 + (c["off"][rec].astype(np.int64) - t)
    s, place = Suffixes(buf), start[rec] + t
    by = _met(s.prefix.at(place, LENGTH), key)
    if not len(by):
        return order[:0], t[:0]
    k, at = key[by], place[by]
    owner = np.zeros(len(buf), np.int64)
    owner[at] = by
    done = s.sort(at, k)
    same = np.r_[False, (k[1:] == k[:-1])]
    near = np.flatnonzero(same)
    hit = s.extension(done[near - 1], done[near]) == LENGTH
    near = near[hit]
    near = near[s.equal(done[near - 1], done[near])]
    w, head = owner[done[near]], owner[done[near - 1]]
    x, y = c[rec[w]], c[rec[head]]
    other = (x["doc"] != y["doc"]) | (x["ver"] != y["ver"]) | (x["lo"] + t[w] != y["lo"] + t[head])
    w = np.sort(w[other])
    return order[rec[w]], t[w]


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _each_bucket(batches, []):
        heads, bodies = [], []
        for data in held:
            n = int.from_bytes(data[:8], "little")
            heads.append(np.frombuffer(data, CONTEXT, n, 8))
            bodies.append(data[8 + n * CONTEXT.itemsize :])
        c = np.concatenate(heads)
        rec, t = repeated_windows(c, b"".join(bodies))
        if len(rec):
            new = np.r_[True, (rec[1:] != rec[:-1]) | (t[1:] != t[:-1] + 1)]
            last = np.r_[new[1:], True]
            x = c[rec[new]]
            yield _hits(x, x["lo"] + t[new], x["lo"] + t[last])


def cleaned(text: bytes, data: list[bytes] | None) -> tuple[bytes, int, int]:
    """Remaining bytes, number removed, number of removed runs."""
    if not data:
        return text, 0, 0
    hits = np.frombuffer(b"".join(data), HIT)
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, hits["lo"], 1)
    np.subtract.at(edge, hits["hi"] + LENGTH, 1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, spans, sha, kept = [], [], [], [], []
            for t, data in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("data").to_pylist(), strict=True):
                left, gone, runs = cleaned(t or b"", data)
                n.append(len(t or b""))
                removed.append(gone)
                spans.append(runs)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            cols = [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.binary())] if with_text else [])], [*names, *(["kept"] if with_text else [])])

    return run


def _versions(text: DataFrame) -> DataFrame:
    """``text`` with ``ver``: 0, or for ids that come with several texts the rank of the text's hash."""
    named = text.withColumn("th", F.xxhash64("text")).withColumn("own", F.xxhash64("doc_id"))
    several = named.groupBy("doc_id", "own").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).filter("lo <> hi").select("own")
    many, one = maybe_in(named, "own", marked(cut(several)), both=True)
    seen = many.select("doc_id", "th").distinct()
    rank = seen.withColumn("ver", F.row_number().over(Window.partitionBy("doc_id").orderBy("th")) - 1)
    ranked = many.join(rank, ["doc_id", "th"]).select("doc_id", "text", "own", F.col("ver").cast("bigint"))
    return ranked.unionByName(one.select("doc_id", "text", "own", F.lit(0).cast("bigint").alias("ver")))


def remove_repeats(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every document.

    Texts are read again rather than kept: only those that may have a block to fetch or a string to lose
    are shuffled.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key, own = ["doc_id", "ver"], F.xxhash64("doc_id").alias("own")
    named = _versions(text.filter("doc_id IS NOT NULL AND text IS NOT NULL"))
    flow = named.mapInArrow(_scan(buckets), FLOW)
    found = cut(flow.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_group, FLOW))
    asked = cut(found.filter("kind = 2").groupBy(*key).agg(F.collect_list("data").alias("data")))
    fetched = maybe_in(named, "own", marked(asked.select(own))).join(asked.hint("shuffle_hash"), key).select(*key, "text", "data").mapInArrow(_fetch(buckets), FLOW)
    more = fetched.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_resolve, FLOW)
    hits = cut(found.filter("kind = 1").unionByName(more).groupBy(*key).agg(F.collect_list("data").alias("data")))
    inside, outside = maybe_in(named, "own", marked(hits.select(own)), both=True)
    none = F.lit(None).cast("array<binary>").alias("data")
    parts = inside.join(hits.hint("shuffle_hash"), key, "left"), outside.withColumn("data", none), text.filter("doc_id IS NULL OR text IS NULL").withColumn("data", none)
    schema = "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING" + (", kept BINARY" if with_text else "")
    every = reduce(DataFrame.unionByName, [x.select("doc_id", "text", "data") for x in parts])
    return every.mapInArrow(_finish(with_text), schema)


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs)
