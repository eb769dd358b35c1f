"""Operator 1: token ids of documents in bit-packed binary files.

File layout (little-endian), one file per range of the document order; blocks are
written as they fill, so a task holds one block and the index, whatever the file's size:

    payload      blocks of ids, each id in ``bits`` bits, low bit first
    doc ends     n_docs x uint64   ids up to the end of each document
    block offs   (n_blocks + 1) x uint64   byte offset of each block in the payload
    trailer      bits, block uint32; n_docs, n_ids uint64; magic 8 bytes b"PACKIDS2"

``bits`` is the least width that holds vocab_size - 1, ``block`` the ids of a block (a
multiple of 64, so blocks end on words).

A block is read with one seek, and unpacked with numpy: its bytes are viewed as
64-bit words, and each id is two shifts away.  ``PackedFile`` reads documents,
ranges of ids or whole files.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common, ragged, tokens

MAGIC = b"PACKIDS2"
TRAILER = struct.Struct("<IIQQ8s")
BLOCK = 8192


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, low bit first, padded to whole 64-bit words."""
    out = np.zeros(-(-len(ids) * bits // 64) + 1, dtype=np.uint64)
    at = np.arange(len(ids), dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    value = ids.astype(np.uint64)
    # ids that start in the same word fill disjoint bits of it: their sum is their union
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(ids):
        out[word[first]] = np.add.reduceat(value << shift, first)
        over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
        out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    return out[:-(-len(ids) * bits // 64)].tobytes()


def unpack(data: bytes | np.ndarray, n: int, bits: int, first: int = 0) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a packed block."""
    words = np.append(np.frombuffer(data, dtype="<u8"), np.uint64(0))
    at = np.arange(first, first + n, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((low | high) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class PackedWriter:
    """Writes the documents of one file to ``out``, each block as soon as it is full."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.sizes: list[int] = []
        self.ends: list[np.ndarray] = []
        self.n_docs = self.n_ids = 0
        self.rest = np.zeros(0, dtype=np.int64)

    def _write(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.sizes.append(len(data))
        self.out.write(data)

    def add(self, bounds: np.ndarray, ids: np.ndarray) -> None:
        self.ends.append((bounds[1:] + self.n_ids).astype("<u8"))
        self.n_docs += len(bounds) - 1
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        full = len(ids) // self.block * self.block
        for i in range(0, full, self.block):
            self._write(ids[i:i + self.block])
        self.rest = ids[full:]

    def finish(self) -> None:
        """Write what is left and the index."""
        if len(self.rest):
            self._write(self.rest)
            self.rest = self.rest[:0]
        for ends in self.ends:
            self.out.write(ends.tobytes())
        self.out.write(np.cumsum([0, *self.sizes]).astype("<u8").tobytes())
        self.out.write(TRAILER.pack(self.bits, self.block, self.n_docs, self.n_ids, MAGIC))


class PackedFile:
    """Random access to a packed file of ``size`` bytes through ``read(offset, length) -> bytes``."""

    def __init__(self, read, size: int):
        self.read = read
        trailer = bytes(read(size - TRAILER.size, TRAILER.size)) if size >= TRAILER.size else b""
        if trailer[-len(MAGIC):] != MAGIC:
            raise ValueError("not a packed id file")
        self.bits, self.block, self.n_docs, self.n_ids, _ = TRAILER.unpack(trailer)
        n_blocks = -(-self.n_ids // self.block)
        at = size - TRAILER.size - 8 * (n_blocks + 1)
        self.offsets = np.frombuffer(read(at, 8 * (n_blocks + 1)), dtype="<u8").astype(np.int64)
        self.ends = np.frombuffer(read(at - 8 * self.n_docs, 8 * self.n_docs), dtype="<u8").astype(np.int64)

    @classmethod
    def of_bytes(cls, content: bytes) -> PackedFile:
        view = memoryview(content)
        return cls(lambda offset, length: view[offset:offset + length], len(content))

    @classmethod
    def open(cls, path: str) -> PackedFile:
        """A file in any store pyarrow reaches; only the asked-for bytes are read."""
        files, inner = common.filesystem(path)
        handle = files.open_input_file(inner)
        return cls(lambda offset, length: handle.read_at(length, offset), handle.size())

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file: touches only the blocks they lie in."""
        out = [np.zeros(0, dtype=np.uint32)]
        for b in range(start // self.block, -(-stop // self.block)):
            base = b * self.block
            lo, hi = max(start, base), min(stop, base + self.block, self.n_ids)
            data = self.read(int(self.offsets[b]), int(self.offsets[b + 1] - self.offsets[b]))
            out.append(unpack(data, hi - lo, self.bits, lo - base))
        return np.concatenate(out)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


_MANIFEST = "file_no int, file string, n_docs long, n_ids long, doc_ids binary, doc_nulls binary"


def write_packed(docs: DataFrame, folder: str, vocabulary: str, end_id: int, n_files: int) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into packed files in ascending doc_id order.

    Null ids come first; rows with equal ids are ordered by a hash of their text;
    null text is empty, so every row has at least its end id.  Returns the
    manifest, one row per file with its document ids.  Each attempt of a task
    writes a file of its own name, and only files of attempts that succeeded are
    in the manifest, so lost executors and repeated tasks leave no wrong data.
    """
    schema = pa.schema([("file_no", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.binary()), ("doc_nulls", pa.binary())])

    def run(batches):
        encoder = tokens.encoder(vocabulary)
        bits = bits_for(max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1))
        number = TaskContext.get().partitionId()
        files, inner = common.filesystem(folder)
        name = f"ids-{number:06d}-{uuid.uuid4().hex}.bin"
        writer, keys, nulls = None, [], []
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                if writer is None:
                    files.create_dir(inner, recursive=True)
                    writer = PackedWriter(files.open_output_stream(f"{inner}/{name}"), bits)
                writer.add(*tokens.with_end(*encoder.ids(part.column("text")), end_id))
                column = part.column("doc_id")
                keys.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(column.is_null().to_numpy(zero_copy_only=False))
        if writer is None:
            return
        writer.finish()
        writer.out.close()
        yield common.batch_of(schema, [number], [name], [writer.n_docs], [writer.n_ids],
                              [np.concatenate(keys).tobytes()], [np.packbits(np.concatenate(nulls)).tobytes()])

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .withColumn("tie", F.xxhash64("text"))
               .repartitionByRange(n_files, "doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie", "text")
               .select("doc_id", "text"))
    return common.stored(ordered.mapInArrow(run, _MANIFEST), "packed-manifest")


_DOCUMENTS = T.StructType([T.StructField(n, T.LongType()) for n in ("file_no", "doc_id", "local_start", "n_tokens",
                                                                     "ids_crc32")])


def read_packed(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the manifest's files: doc_id, start, n_tokens, ids_crc32.

    Each task opens its files and unpacks them; ``start`` adds the id totals of
    the files before, a running sum over the manifest's few numbers.
    """
    schema = pa.schema([(f.name, pa.int64()) for f in _DOCUMENTS])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                packed = PackedFile.open(f"{folder}/{row['file']}")
                assert (packed.n_docs, packed.n_ids) == (row["n_docs"], row["n_ids"])
                keys = np.frombuffer(row["doc_ids"], dtype="<i8")
                nulls = np.unpackbits(np.frombuffer(row["doc_nulls"], dtype=np.uint8), count=len(keys)).astype(bool)
                starts = np.concatenate([[0], packed.ends[:-1]])
                step = 2000
                for lo in range(0, len(keys), step):
                    hi = min(lo + step, len(keys))
                    ids = packed.ids(int(starts[lo]), int(packed.ends[hi - 1])).astype("<u4").tobytes()
                    base = starts[lo]
                    crc = [zlib.crc32(ids[4 * (s - base):4 * (e - base)])
                           for s, e in zip(starts[lo:hi].tolist(), packed.ends[lo:hi].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(hi - lo, row["file_no"])), pa.array(keys[lo:hi], mask=nulls[lo:hi]),
                         pa.array(starts[lo:hi]), pa.array(packed.ends[lo:hi] - starts[lo:hi]),
                         pa.array(crc, type=pa.int64())], schema=schema)

    n_files = max(1, manifest.count())
    documents = manifest.repartition(n_files).mapInArrow(run, _DOCUMENTS)
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("file_no", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return (documents.join(bases, "file_no")
            .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"))


def packed_token_ids(docs: DataFrame, vocabulary: str, end_id: int = 1, file_bytes: int = common.TARGET_BYTES,
                     folder: str | None = None) -> DataFrame:
    """Write ``docs`` as packed id files and read every document back from them.

    Empty table: no file, no row.  Other columns of ``docs`` are ignored.
    """
    folder = folder or common.shared_folder(docs.sparkSession, "packed-ids")
    manifest = write_packed(docs, folder, vocabulary, end_id, common.parts_for(common.text_bytes(docs), file_bytes))
    return read_packed(manifest, folder)


def query(spark, sf_dir) -> DataFrame:
    """op1: ids of word_bpe_49k.json, end id 1, through packed files."""
    return packed_token_ids(common.documents(spark, sf_dir), common.tokenizer_path("word_bpe_49k.json"))
