"""Token-id shards with Elias-Fano document boundaries.

One shard file (little-endian throughout)::

    b"LFEF" version:u8 width:u8           header, 6 bytes
    ids                                   all documents' ids, one after another, u16 or u32 by ``width``
    footer                                see Footer: counts, end offsets and keys as two Elias-Fano sequences
    footer_bytes:u64 b"LFEF"              trailer, 12 bytes

No table of 64-bit offsets is kept: n ends below u take ``2 + log2(u / n)`` bits
each, plus one 64-bit sample for every ``SAMPLE`` documents for ``select``.

A task writes its shard under a name of its own and reports it; only reported
files are read, so a task that is run again after a lost executor does no harm.
"""

from __future__ import annotations

import functools
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import bounded_batches, scratch_path, slices, table, text_or_empty

MAGIC, VERSION, SAMPLE = b"LFEF", 1, 256
END_ID = 2


@dataclass
class EliasFano:
    """A non-decreasing sequence of unsigned integers with random access by ``select``."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: np.ndarray

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", np.zeros(0, np.uint64))
        low_bits = max(0, ((int(v[-1]) + 1) // n).bit_length() - 1)
        ones = ((v >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel() if low_bits else np.zeros(0, np.uint8)
        pack = lambda b: np.packbits(b, bitorder="little").tobytes()
        return cls(n, low_bits, pack(low), pack(bits), ones[::SAMPLE].astype(np.uint64))

    def _low(self, i: int) -> int:
        start = i * self.low_bits
        word = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8], "little")
        return (word >> (start % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample and a count of ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        word = self.high[byte] >> skip << skip
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        return (position - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """Every value in order, as unsigned 64-bit integers; for sequential reads."""
        if not self.n:
            return np.zeros(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n].astype(np.uint64)
        out = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little", count=self.n * self.low_bits)
            bits = bits.reshape(self.n, self.low_bits).astype(np.uint64)
            for k in range(self.low_bits):
                out |= bits[:, k] << np.uint64(k)
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high + self.samples.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, n_low, n_high = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        return cls(n, low_bits, data[at : at + n_low], data[at + n_low : at + n_low + n_high], np.frombuffer(data, "<u8", offset=at + n_low + n_high))


@dataclass
class Footer:
    """``ends``: ids up to the end of each document; ``keys``: doc_id less ``base``; the first ``nulls`` documents have none."""

    n_ids: int
    nulls: int
    base: int
    ends: EliasFano
    keys: EliasFano

    def to_bytes(self) -> bytes:
        ends = self.ends.to_bytes()
        return struct.pack("<QQqQ", self.n_ids, self.nulls, self.base, len(ends)) + ends + self.keys.to_bytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Footer:
        n_ids, nulls, base, n_ends = struct.unpack_from("<QQqQ", data)
        at = struct.calcsize("<QQqQ")
        return cls(n_ids, nulls, base, EliasFano.from_bytes(data[at : at + n_ends]), EliasFano.from_bytes(data[at + n_ends :]))

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.keys.select(i - self.nulls) + self.base

    def span(self, i: int) -> tuple[int, int]:
        """The places of document i's ids within the shard."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)


class ShardWriter:
    """Appends documents in ascending key order (null keys first) and closes with the footer."""

    def __init__(self, out, width: int):
        self.out, self.width, self.n_ids, self.keys, self.ends = out, width, 0, [], []
        out.write(MAGIC + bytes([VERSION, width]))

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}", copy=False).tobytes())
        self.n_ids += len(ids)
        self.keys.append(key)
        self.ends.append(self.n_ids)

    def close(self) -> None:
        known = [k for k in self.keys if k is not None]
        base = known[0] if known else 0
        keys = [k - base for k in known]
        data = Footer(self.n_ids, len(self.keys) - len(known), base, EliasFano.of(self.ends), EliasFano.of(keys)).to_bytes()
        self.out.write(data + struct.pack("<Q", len(data)) + MAGIC)


class ShardReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(0)
        head = source.read(6)
        source.seek(size - 12)
        tail = source.read(12)
        if head[:4] != MAGIC or tail[8:] != MAGIC or head[4] != VERSION:
            raise ValueError("not a whole shard file")
        self.width = head[5]
        source.seek(size - 12 - (n := struct.unpack("<Q", tail[:8])[0]))
        self.footer = Footer.from_bytes(source.read(n))

    def __len__(self) -> int:
        return self.footer.ends.n

    def ids(self, start: int, end: int) -> np.ndarray:
        self.source.seek(6 + start * self.width)
        return np.frombuffer(self.source.read((end - start) * self.width), f"<u{self.width}")

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """One document by its place, without touching the others."""
        return self.footer.key(i), self.ids(*self.footer.span(i))

    def documents(self, at_once: int = 256) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, start within the shard, ids) of all documents in order, a bounded run of them read at once."""
        ends = self.footer.ends.all().astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        keys = [None] * self.footer.nulls + [int(k) + self.footer.base for k in self.footer.keys.all()]
        for low in range(0, len(ends), at_once):
            high = min(low + at_once, len(ends))
            run = self.ids(int(starts[low]), int(ends[high - 1]))
            for i in range(low, high):
                yield keys[i], int(starts[i]), run[starts[i] - starts[low] : ends[i] - starts[low]]


# ---- encoding ---------------------------------------------------------------

_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
#: The byte-level pre-tokenizer's pattern for texts of Latin-1 characters only, whose classes no Unicode version changes.
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a printable letter for each byte, as a translation of Latin-1 characters."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words(dict):
    """The ids of words, as bytes; a new word's are asked from the library's model.  Beyond ``keep`` words it starts anew."""

    def __init__(self, tokenizer, dtype: str, keep: int):
        super().__init__()
        self.tokenize, self.code, self.keep, self.letters = tokenizer.model.tokenize, "H" if dtype == "<u2" else "I", keep, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.keep:
            self.clear()
        letters = word.encode().decode("latin-1").translate(self.letters)
        ids = self[word] = array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()
        return ids


class WordEncoder:
    """The tokenizers library's ids of whole texts.

    A byte-level tokenizer cuts a text into words and encodes each on its own, so
    the ids of a word are kept and the library's model is asked once for each new
    one.  Texts beyond Latin-1, and tokenizers that aren't plain byte-level ones, go
    to the library whole.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        pre = str(self.tokenizer.pre_tokenizer)
        plain = self.tokenizer.normalizer is None and "ByteLevel(add_prefix_space=False" in pre and "use_regex=True" in pre
        self.words = Words(self.tokenizer, self.dtype, keep) if plain and sys.byteorder == "little" else None

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole([text])[0]
        if self.words is None:
            return self.whole([text])[0]
        return np.frombuffer(b"".join(map(self.words.__getitem__, LATIN_WORDS.findall(text))), self.dtype)


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _open(path: str):
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path)
    return where, at


def write_shards(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", *, tokenizer: str | None = None, end_id: int | None = END_ID) -> list[tuple[str, int, int]]:
    """Encode whole texts and write them, in ascending key order over all shards, to files in ``folder`` (a shared one).

    Returns (path, documents, ids) of each shard in order; that list has an entry
    for each task and is the only thing the driver sees.  A null text is empty, so
    its ids are ``end_id`` alone; null keys come first; rows with equal keys stay
    together in the order of their text's hash; an empty table writes no shard.
    The range partitioning also takes that hash, so that many rows of one key can
    be split over shards.
    """
    path = tokenizer or default_tokenizer()
    src = bounded_batches(df.select(F.col(key).cast("bigint").alias("key"), text_or_empty(text).alias("body")))
    src = src.withColumn("tie", F.xxhash64("body"))
    src = src.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = word_encoder(path), TaskContext.get().partitionId()
        out = writer = None
        name = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.lfef"
        for batch in batches:
            for some in slices(batch, 256):
                for k, body in zip(some.column("key").to_pylist(), some.column("body").to_pylist(), strict=True):
                    if writer is None:
                        where, at = _open(name)
                        where.create_dir(at.rpartition("/")[0], recursive=True)
                        out = where.open_output_stream(at, buffer_size=1 << 20)
                        writer = ShardWriter(out, np.dtype(encode.dtype).itemsize)
                    ids = encode(body)
                    writer.add(k, ids if end_id is None else np.append(ids, ids.dtype.type(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [len(writer.ends)], "n_ids": [writer.n_ids]})

    found = src.mapInArrow(run, "part bigint, path string, n_docs bigint, n_ids bigint").collect()
    return [(r.path, r.n_docs, r.n_ids) for r in sorted(found, key=lambda r: r.part)]


def read_shards(spark, shards: list[tuple[str, int, int]], batch_rows: int = 4096, *, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (little-endian unsigned 32-bit) of every document, read from the files; one task a shard."""
    with_ids = ids
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    if not shards:
        return spark.createDataFrame([], schema)
    starts = np.concatenate([[0], np.cumsum([n for _, _, n in shards])])[:-1]
    files = spark.createDataFrame([(p, int(s)) for (p, _, _), s in zip(shards, starts, strict=True)], "path string, start bigint").repartition(len(shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                where, at = _open(path)
                rows, held = [], 0
                with where.open_input_file(at) as source:
                    for key, start, ids in ShardReader(source).documents():
                        data = ids.astype("<u4").tobytes()
                        row = (key, first + start, len(ids), zlib.crc32(data))
                        rows.append((*row, data) if with_ids else row)
                        held += len(data) if with_ids else 0
                        if len(rows) >= batch_rows or held > 1 << 24:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return files.mapInArrow(run, schema)


def op2_token_files(spark, sf_dir):
    """Write the ids of all documents, read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = scratch_path(spark, "ids")
    shards = write_shards(table(spark, sf_dir, "documents"), folder)
    return read_shards(spark, shards, ids=False)
