"""Token ids in fixed-width bit packing, with random access.

A file is a table of blocks in the shared folder, written and committed by Spark's own writer, so it
lives in any store Spark reaches and a task that runs again leaves no half block. A block image:

    magic "FWBP" | width u8 | 3 zero bytes | n_docs u32 | n_ids u64 | doc ids i64 [n_docs] |
    null flags u8 [n_docs] | lengths u32 [n_docs] | ids, ``width`` bits each, lowest bit first

Width is the fewest bits that hold the vocabulary. Id i of a block starts at bit i * width. ``index`` gives
the place of every block among all ids, so ``read_at`` finds any id by reading one block.

Cases: a null or empty text holds the end id alone; null doc ids come first, then ascending, equal
ids in order of their text; repeated rows are stored each; an empty table gives no rows; other
columns are ignored; the strings of special tokens become these, as the library has it; long texts are encoded between blanks, piece by piece.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import fresh_path

MAGIC, HEAD = b"FWBP", struct.Struct("<4sB3xIQ")
#: Ids after which a block is closed.
BLOCK = 1_000_000
CACHE, PIECE, WORD = 700_000, 2_000_000, 200
#: shard: place of the task in the order of doc ids; first: ids before the block in its shard.
COLUMNS = "shard BIGINT, first BIGINT, n_ids BIGINT, image BINARY"
#: Marks that the library splits from a letter before them.
MARKS = frozenset(",.!?;:|")
#: What every special token begins with.
SPECIAL = "<|"
#: Letters below this are composed already, and lower case and letter classes agree everywhere.
PLAIN_LETTERS = "\u0250"


def byte_letters() -> str:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the characters from 256 on, in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(other)) for b in range(256))


BYTE_LETTERS = byte_letters()


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """64 ids fill ``width`` 64-bit words; lane by lane over all groups at once."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros(groups * 64, np.uint64)
    lanes[: len(ids)] = ids
    lanes, words = lanes.reshape(groups, 64), np.zeros((groups, width), "<u8")
    for k in range(64):
        at, shift = divmod(k * width, 64)
        words[:, at] |= lanes[:, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= lanes[:, k] >> np.uint64(64 - shift)
    return words.tobytes()[: -(-len(ids) * width // 8)]


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    groups = -(-n // 64)
    words = np.frombuffer(bytes(data).ljust(groups * width * 8, b"\0"), "<u8").reshape(groups, width)
    out, mask = np.empty((groups, 64), np.uint32), np.uint64((1 << width) - 1)
    for k in range(64):
        at, shift = divmod(k * width, 64)
        x = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[:, at + 1] << np.uint64(64 - shift)
        out[:, k] = x & mask
    return out.reshape(-1)[:n]


def write_block(docs: list[tuple[int | None, np.ndarray]], width: int) -> bytes:
    ids = np.concatenate([x for _, x in docs])
    head = HEAD.pack(MAGIC, width, len(docs), len(ids))
    keys = np.array([d or 0 for d, _ in docs], "<i8").tobytes() + bytes(d is None for d, _ in docs)
    return head + keys + np.array([len(x) for _, x in docs], "<u4").tobytes() + pack(ids, width)


def _layout(block: bytes) -> tuple[int, int, int, int]:
    magic, width, n_docs, n_ids = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of packed ids")
    return width, n_docs, n_ids, HEAD.size + 13 * n_docs


def read_block(block: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc id, place of its first id in the block, ids) of each document."""
    width, n_docs, n_ids, body = _layout(block)
    keys = np.frombuffer(block, "<i8", n_docs, HEAD.size)
    null = np.frombuffer(block, np.uint8, n_docs, HEAD.size + 8 * n_docs)
    size = np.frombuffer(block, "<u4", n_docs, HEAD.size + 9 * n_docs).astype(np.int64)
    ids, start = unpack(block[body:], n_ids, width), np.cumsum(size) - size
    for k, z, a, n in zip(keys.tolist(), null.tolist(), start.tolist(), size.tolist(), strict=True):
        yield (None if z else k), a, ids[a : a + n]


def read_id(block: bytes, i: int) -> int:
    """One id of a block, without unpacking the others."""
    width, _, n_ids, body = _layout(block)
    if not 0 <= i < n_ids:
        raise IndexError(i)
    first, shift = divmod(i * width, 8)
    part = int.from_bytes(block[body + first : body + first + (shift + width + 7) // 8], "little")
    return part >> shift & ((1 << width) - 1)


def _byte_level(word: str) -> str | None:
    """The byte-level form of a word of plain letters, in lower case; None for any other word."""
    if not word.isalpha():
        return None
    if word.isascii():
        return word.lower()
    low = word.lower()
    if max(word) >= PLAIN_LETTERS or not low.isalpha():
        return None
    return low.encode().decode("latin-1").translate(BYTE_LETTERS)


class WordEncoder(dict):
    """The library's encoding, word by word: its matches and its normalisation never cross a blank.

    Maps a word to its ids, learning those it has not; ``trim`` keeps it bounded.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.plain: dict[str, bytes] = {}
        self.marks = {m: self._ids(m) for m in MARKS}

    def width(self) -> int:
        return width_of(self.lib.get_vocab_size())

    def _ids(self, form: str) -> bytes:
        if (seen := _byte_level(form)) is None:
            return array("I", self.lib.encode(form, add_special_tokens=False).ids).tobytes()
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        """Case of ASCII words does not matter to the library, and a mark after a letter is a match of
        its own, so words share their plain forms. A form of plain letters is one match that
        normalisation leaves alone, and goes to the library's model directly.
        """
        form, mark = word.lower() if word.isascii() and SPECIAL not in word else word, b""
        if SPECIAL in word:  # may hold a special token, which the library finds in the text as it stands
            pass
        elif form[-1] in self.marks and form[-2:-1].lower().isalpha():
            form, mark = form[:-1], self.marks[form[-1]]
        if (ids := self.plain.get(form)) is None:
            ids = self._ids(form)
            if len(form) <= WORD:
                self.plain[form] = ids
        ids += mark
        if len(word) <= WORD:
            self[word] = ids
        return ids

    def trim(self) -> None:
        if len(self) > CACHE:
            self.clear()
            self[""] = b""
        if len(self.plain) > CACHE:
            self.plain.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian 32-bit."""
        out, size, got = [], 0, self.__getitem__
        for t in texts:
            t = (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ")
            parts, a = [], 0
            while a < len(t):
                b = t.find(" ", a + PIECE)
                b = len(t) if b < 0 else b
                parts.append(b"".join(map(got, t[a:b].split(" "))))
                size += b - a
                a = b
                if size > PIECE:
                    self.trim()
                    size = 0
            out.append(b"".join(parts))
        self.trim()
        return out


_words: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _words:
        _words[path] = WordEncoder(path)
    return _words[path]


def write(docs: DataFrame, out: str, path: str, end_id: int) -> None:
    """Encodes the documents in ascending order of doc_id and writes the blocks to ``out``."""
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = word_encoder(path)
        width, shard, first, held, count = enc.width(), TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            cols = [pa.array([shard]), pa.array([first]), pa.array([count]), pa.array([write_block(held, width)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["shard", "first", "n_ids", "image"])

        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                    held.append((doc, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))))
                    count += len(held[-1][1])
                    if count >= BLOCK:
                        yield close()
                        first, held, count = first + count, [], 0
        if held:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, COLUMNS).write.parquet(out)


def _placed(spark, out: str) -> DataFrame:
    """The blocks with ``start``, the ids of all blocks before."""
    blocks = spark.read.schema(COLUMNS).parquet(out)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    placed = blocks.join(F.broadcast(shards), "shard")  # a row per shuffle partition, so its size is a setting's
    return placed.withColumn("start", F.col("_before") + F.col("first"))


def index(spark, out: str) -> DataFrame:
    """(start, n_ids, shard, first) of every block; its ids stand at start, start + 1, ... among all. Reads no image."""
    return _placed(spark, out).select("start", "n_ids", "shard", "first")


def read_at(spark, out: str, place: int) -> int:
    """The id at a place among those of all documents, from the one block that holds it."""
    found = index(spark, out).filter((F.col("start") <= place) & (place < F.col("start") + F.col("n_ids"))).first()
    if found is None:
        raise IndexError(place)
    block = spark.read.schema(COLUMNS).parquet(out).filter((F.col("shard") == found["shard"]) & (F.col("first") == found["first"]))
    return read_id(block.select("image").first()["image"], place - found["start"])


def read(spark, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, from the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, image in zip(b.column("first").to_pylist(), b.column("image"), strict=True):
                rows = [(d, first + a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, a, x in read_block(image.as_py())]
                cols = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, out).select(F.col("start").alias("first"), "image").mapInArrow(run, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")


def query(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    out = fresh_path(docs.sparkSession, "packed")
    write(docs, out, path, end_id)
    return read(docs.sparkSession, out)
