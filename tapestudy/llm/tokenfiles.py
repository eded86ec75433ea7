"""Token ids on disk: files of separately compressed documents under one shared zstandard dictionary.

A stored corpus is a folder with three parts:

- `dictionary`: one Parquet row, the zstandard dictionary trained on serialized id arrays and its SHA-256. It is trained on
  at most `sample_docs` documents (about those whose id hashes lowest), of each one stretch of at most `sample_ids` ids.
- `files`: one binary file per range of documents in ascending doc_id order. A header (magic, version, bytes per id, SHA-256
  of the dictionary), one zstandard frame per document, an index (doc_id, offset of the frame, number of ids), a footer that
  tells where the index stands. One document is read with the index and its own frame alone.
- `manifest`: one Parquet row per file: name, number of documents and ids, first and last doc_id, ids of all files before.

Every attempt of a task writes a file of its own name and reports it as a row; only rows of attempts that Spark committed
reach the manifest, so lost executors and repeated tasks leave no double documents (at most files that nobody names).

Texts are encoded with the tokenizers library: a text is cut at spaces, ids of pieces are kept in a table of bounded size, and
the new pieces of many documents are encoded in one call and told apart by the bytes that their tokens stand for.

Nulls and edge cases: a null or empty text has the end id alone; rows without doc_id come first and are found by no look-up;
rows that share a doc_id stand next to each other, ordered by checksum; very long texts are one frame; an empty table gives
an empty manifest; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .bpe import WHITE, byte_symbols
from .common import batch_of, keep_first, text_batches, two_columns

END = 2
MAGIC, VERSION = b"TAPEIDS\0", 1
HEADER, FOOTER = "<8sHH32s", "<QQQ8s"
KEPT = 700_000
#: Characters of text that are encoded together.
TOGETHER = 2_000_000
LEVEL = 3


class PieceIds:
    """Ids of whole texts from a byte-level vocabulary of the tokenizers library.

    A piece is what stands behind a space or from a line end on, up to the next of them. Where white space comes alone, no token
    reaches over the borders of pieces, and the ids of a text are those of its pieces; any other text is cut by a pattern:
    white space with what stands behind it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        symbols, vocabulary = byte_symbols(), self.tokenizer.get_vocab()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.encode()) if token in special else sum(c in symbols for c in token)
        self.kind = np.dtype("<u2" if len(self.sizes) <= 1 << 16 else "<u4")
        self.pattern = re.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.white = frozenset(c for c in map(chr, range(1 << 14)) if re.match(f"[{WHITE}]", c))
        self.special = special
        self.known, self.exact = {}, {}  # ids of a piece with what stands before it (none if it cannot stand alone), of a piece as it is

    def _each(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that begin with white space and end without: one text, cut by the bytes that its tokens stand for."""
        out = []
        for i in range(0, len(pieces), 20_000):
            some = pieces[i:i + 20_000]
            (joined,) = self._each(["".join(some)])
            reached = np.cumsum(self.sizes[np.frombuffer(joined, self.kind)])
            ends = np.cumsum([len(p.encode()) for p in some])
            last = np.searchsorted(reached, ends)
            if last[-1] < len(reached) and (reached[last] == ends).all():
                at = [0, *((last + 1) * self.kind.itemsize).tolist()]
                out += [joined[a:b] for a, b in zip(at, at[1:])]
            else:
                out += self._each(some)
        return out

    def _learn(self, new: set) -> None:
        white, plain = self.white, []
        for p in new:
            if p and p[-1] not in white and (p[0] not in white or p[0] == "\n" and p[1] not in white):
                plain.append(p)
            else:
                self.known[p] = self._each(["\n"])[0] if p == "\n" else None
        self.known.update(zip(plain, self._joined([p if p[0] == "\n" else " " + p for p in plain])))

    def _exactly(self, pieces: list[list[str]]) -> None:
        keep_first(self.exact, KEPT)
        new = list(set().union(*pieces).difference(self.exact))
        self.exact.update(zip(new, self._each(new)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the new pieces of all of them are encoded together."""
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        firsts = [c.pop(0) for c in cut]
        keep_first(self.known, KEPT)
        if new := set().union(*cut).difference(self.known):
            self._learn(new)
        self._exactly([firsts])
        known, exact, out, odd = self.known, self.exact, [None] * len(texts), []
        for i, (t, first, rest) in enumerate(zip(texts, firsts, cut)):
            if any(x in t for x in self.special) or " \n" in t or "\n\n\n" in t or "\n\n " in t or t[-1:] in self.white or rest and first[-1:] in self.white:
                odd.append(i)
                continue
            try:
                out[i] = exact[first] + b"".join(map(known.__getitem__, rest))
            except TypeError:
                odd.append(i)
        pieces = [self.pattern.findall(texts[i]) for i in odd]
        self._exactly(pieces)
        for i, p in zip(odd, pieces):
            out[i] = b"".join(map(self.exact.__getitem__, p))
        return [np.frombuffer(x, self.kind) for x in out]


_loaded: dict[str, PieceIds] = {}


def encoded(batches, vocabulary: str, text: str = "text"):
    """(batch, first row, ids of each text) of slices of about TOGETHER characters. A worker keeps one encoder."""
    if vocabulary not in _loaded:
        _loaded.clear()
        _loaded[vocabulary] = PieceIds(vocabulary)
    tokens = _loaded[vocabulary]
    for b in batches:
        texts = [t or "" for t in b.column(text).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < TOGETHER:
                size += len(texts[end])
                end += 1
            yield b, at, tokens.encode(texts[at:end])
            at = end


@dataclass(frozen=True)
class Stored:
    """A stored corpus: its folder and how ids are kept."""
    folder: str
    bytes_per_id: int
    dictionary: bytes

    @property
    def digest(self) -> bytes:
        return hashlib.sha256(self.dictionary).digest()

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/manifest")


def open_stored(spark: SparkSession, folder: str) -> Stored:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    stored = Stored(folder, row.bytes_per_id, bytes(row.dictionary))
    if stored.digest != bytes(row.sha256):
        raise ValueError(f"the dictionary of {folder} does not have the hash noted beside it")
    return stored


def _file_system(uri: str):
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9]+:/", uri) else (fs.LocalFileSystem(), uri)


def _zdict(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO) if dictionary else None


def sample(docs: DataFrame, vocabulary: str, key: str, text: str, sample_docs: int, sample_ids: int) -> list[bytes]:
    """Serialized stretches of ids, one of each of at most ``sample_docs`` documents: the only rows that reach the driver."""
    rows = two_columns(docs, key, text, "string")
    count = rows.count()
    share = min(1.0, sample_docs / max(count, 1))
    low = int(share * (1 << 40))
    some = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 24) < low)

    def run(batches):
        for b, at, ids in encoded(batches, vocabulary):
            keys = b.column("doc_id").to_pylist()[at:at + len(ids)]
            parts = []
            for k, x in zip(keys, ids):
                start = zlib.crc32(str(k).encode()) % max(1, len(x) - sample_ids + 1)
                parts.append(x[start:start + sample_ids].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["part"])

    return [bytes(r.part) for r in some.mapInArrow(run, "part binary").where("length(part) > 0").limit(sample_docs).collect()]


def train_dictionary(parts: list[bytes], size: int) -> bytes:
    """A dictionary from sampled id arrays; too few of them are the dictionary themselves."""
    total = sum(map(len, parts))
    if total == 0:
        return b""
    try:
        return zstandard.train_dictionary(max(256, min(size, total // 8)), parts, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:size]


def _blobs(docs: DataFrame, vocabulary: str, stored: Stored, key: str, text: str, end: int) -> DataFrame:
    """doc_id, checksum, number of ids and compressed ids of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("crc", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
    kind, dictionary = np.dtype(f"<u{stored.bytes_per_id}"), stored.dictionary

    def run(batches):
        shared = _zdict(dictionary)
        if shared is not None:
            shared.precompute_compress(level=LEVEL)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        last = np.array([end], kind)
        for b, at, ids in encoded(batches, vocabulary):
            whole = [np.concatenate((x, last)).astype(kind) for x in ids]
            yield batch_of(schema, b.column("doc_id").to_pylist()[at:at + len(ids)], [zlib.crc32(x.astype("<u4").tobytes()) for x in whole],
                           [len(x) for x in whole], [squeeze(x.tobytes()) for x in whole])

    return two_columns(docs, key, text, "string").mapInArrow(run, "doc_id bigint, crc bigint, n bigint, blob binary")


def _write_files(stored: Stored):
    """Writes one file per task from rows in doc_id order and reports it."""
    folder, digest, width = f"{stored.folder}/files", stored.digest, stored.bytes_per_id
    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())])

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        system, path = _file_system(folder)
        name, out, at = f"{part:06d}-{uuid.uuid4().hex[:12]}.ids", None, struct.calcsize(HEADER)
        keys, sizes, counts = [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}")
                out.write(struct.pack(HEADER, MAGIC, VERSION, width, digest))
            blobs = b.column("blob").to_pylist()
            out.write(b"".join(blobs))
            keys.append(b.column("doc_id"))
            sizes.append(np.fromiter(map(len, blobs), np.int64, len(blobs)))
            counts.append(b.column("n").to_numpy())
        if out is None:
            return
        keys, sizes, counts = pa.chunked_array(keys), np.concatenate(sizes), np.concatenate(counts)
        named = keys.is_valid().to_numpy()
        ids = keys.fill_null(0).to_numpy()
        offsets = at + np.concatenate(([0], np.cumsum(sizes)))
        index = zstandard.compress(b"".join((ids.astype("<i8").tobytes(), named.astype("u1").tobytes(), offsets.astype("<i8").tobytes(), counts.astype("<i8").tobytes())))
        out.write(index)
        out.write(struct.pack(FOOTER, int(offsets[-1]), len(index), len(ids), MAGIC))
        out.close()
        some = ids[named]
        bounds = (int(some[0]), int(some[-1])) if len(some) else (None, None)
        yield batch_of(schema, [part], [name], [len(ids)], [int(counts.sum())], [bounds[0]], [bounds[1]])

    return run


class TokenFile:
    """One file opened for reading; the dictionary is checked against the hash in its header."""

    def __init__(self, stored: Stored, name: str):
        system, path = _file_system(f"{stored.folder}/files/{name}")
        self.file = system.open_input_file(path)
        magic, version, width, digest = struct.unpack(HEADER, self.file.read_at(struct.calcsize(HEADER), 0))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{name} is not a token file of version {VERSION}")
        if digest != stored.digest:
            raise ValueError(f"{name} was written with another dictionary")
        size = self.file.size()
        at, length, n, magic = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC or at + length + struct.calcsize(FOOTER) != size:
            raise ValueError(f"{name} is cut off")
        index = zstandard.decompress(self.file.read_at(length, at))
        self.docs = np.frombuffer(index, "<i8", n)
        self.named = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.offsets = np.frombuffer(index, "<i8", n + 1, 9 * n)
        self.counts = np.frombuffer(index, "<i8", n, 17 * n + 8)
        self.starts = np.cumsum(self.counts) - self.counts
        self.kind = np.dtype(f"<u{width}")
        self.expand = zstandard.ZstdDecompressor(dict_data=_zdict(stored.dictionary)).decompress

    def stretches(self, size: int = 4 << 20):
        """(row, ids) of all documents, read in stretches of about ``size`` bytes."""
        row, n = 0, len(self.counts)
        while row < n:
            end = max(row + 1, int(np.searchsorted(self.offsets, self.offsets[row] + size, "right")) - 1)
            base = int(self.offsets[row])
            raw = memoryview(self.file.read_at(int(self.offsets[end]) - base, base))
            for i in range(row, end):
                yield i, np.frombuffer(self.expand(raw[int(self.offsets[i]) - base:int(self.offsets[i + 1]) - base]), self.kind)
            row = end

    def rows_of(self, docs: np.ndarray) -> np.ndarray:
        """Rows of the documents with these ids; rows without an id come first and are none of them."""
        first = int((~self.named).sum())
        return first + np.flatnonzero(np.isin(self.docs[first:], docs))

    def ids(self, row: int) -> np.ndarray:
        a, b = int(self.offsets[row]), int(self.offsets[row + 1])
        return np.frombuffer(self.expand(self.file.read_at(b - a, a)), self.kind)


def store(docs: DataFrame, vocabulary: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end: int = END, dictionary_size: int = 1 << 16,
          sample_docs: int = 2000, sample_ids: int = 2048, file_bytes: int = 32 << 20) -> Stored:
    """Writes the ids of every whole text, with ``end`` behind each document, below ``folder`` (a new one in the shared folder if None)."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-ids")
    tokens = PieceIds(vocabulary)
    stored = Stored(folder, tokens.kind.itemsize, train_dictionary(sample(docs, vocabulary, key, text, sample_docs, sample_ids), dictionary_size))
    del tokens
    spark.createDataFrame([(stored.bytes_per_id, stored.dictionary, stored.digest)], "bytes_per_id int, dictionary binary, sha256 binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    _blobs(docs, vocabulary, stored, key, text, end).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/encoded")
    blobs = spark.read.schema("doc_id bigint, crc bigint, n bigint, blob binary, row bigint").parquet(f"{folder}/encoded")
    size = blobs.agg(F.sum(F.length("blob"))).first()[0] or 0
    # rows that share a doc_id are spread over files by checksum and row
    files = int(max(1, size // file_bytes, min(spark.sparkContext.defaultParallelism, size >> 20)))
    ranged = blobs.repartitionByRange(files, "doc_id", "crc", "row").sortWithinPartitions("doc_id", "crc", "row").select("doc_id", "n", "blob")
    written = "part int, file string, n_docs bigint, n_ids bigint, first_doc bigint, last_doc bigint"
    ranged.mapInArrow(_write_files(stored), written).write.parquet(f"{folder}/written")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    named = spark.read.schema(written).parquet(f"{folder}/written").withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    named.write.parquet(f"{folder}/manifest")
    return stored


def _by_file(stored: Stored, spark: SparkSession, work, schema: pa.Schema, kinds: str) -> DataFrame:
    """Runs ``work(file, ids_before)``, which yields column lists, once per file of the manifest; a file is one task's."""
    manifest = stored.manifest(spark)
    files = manifest.count()

    def run(batches):
        for b in batches:
            for name, before in zip(b.column("file").to_pylist(), b.column("ids_before").to_pylist()):
                for columns in work(TokenFile(stored, name), before):
                    yield batch_of(schema, *columns)

    return manifest.select("file", "ids_before").repartitionByRange(max(1, files), "ids_before").mapInArrow(run, kinds)


def _many(rows, n: int):
    """Column lists of up to ``n`` rows."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield zip(*held)
            held = []
    if held:
        yield zip(*held)


def read(stored: Stored, spark: SparkSession) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids of every stored document."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def work(file, before):
        rows = ((int(file.docs[i]) if file.named[i] else None, before + int(file.starts[i]), ids) for i, ids in file.stretches())
        yield from _many(rows, 256)

    return _by_file(stored, spark, work, schema, "doc_id bigint, start bigint, ids array<bigint>")


def read_some(stored: Stored, spark: SparkSession, doc_ids: list[int]) -> DataFrame:
    """As ``read`` for a short list of ids: of each file that can hold one, the index and the frames of these documents are read."""
    wanted = np.array(sorted(set(doc_ids)), np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for name, before, low, high in zip(*(b.column(c).to_pylist() for c in ("file", "ids_before", "first_doc", "last_doc"))):
                near = wanted[np.searchsorted(wanted, low):np.searchsorted(wanted, high, "right")]
                if len(near):
                    file = TokenFile(stored, name)
                    for columns in _many(((int(file.docs[i]), before + int(file.starts[i]), file.ids(i)) for i in file.rows_of(near)), 256):
                        yield batch_of(schema, *columns)

    return stored.manifest(spark).where("first_doc IS NOT NULL").select("file", "ids_before", "first_doc", "last_doc").mapInArrow(run, "doc_id bigint, start bigint, ids array<bigint>")


def digest(stored: Stored, spark: SparkSession) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit integers) of every document, read from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def work(file, before):
        rows = ((int(file.docs[i]) if file.named[i] else None, before + int(file.starts[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, ids in file.stretches())
        yield from _many(rows, 10_000)

    return _by_file(stored, spark, work, schema, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
