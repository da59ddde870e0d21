"""Token-ID output: seekable zstandard files of uint32 ids.

A file is a run of independent zstandard frames, each with its own content
checksum, then a skippable frame with the document index and, last, the seek table of
the public zstandard seekable format: compressed size, decompressed size and the low
32 bits of the xxh64 of each frame's content. A reader takes the footer, the index and
only the frames of the documents it wants. Files are named by partition in
ascending doc_id order, written under a temporary name and renamed, so a retried task
leaves one whole file.

Documents are encoded by white-space-separated chunks, cached: the tokenizer's
normaliser and splitter never look across ASCII white space, so ids are those of the
whole text. A chunk below U+0300 goes through the library's BPE model piece by piece; any
other chunk through the library's whole pipeline. So goes a whole text that contains the
string of an added token, which the library looks for before it splits.

Edge cases: a null text is empty and holds only the end id; repeated rows are kept,
each with its own span; null doc_ids come first; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import fingerprint, fresh_path, tune

END_ID = 1
FRAME_BYTES = 1 << 20
LEVEL = 3
#: Entries of a generation of chunks, and of pieces of mixed chunks; at most two of each are held.
CACHE, PIECES = 550_000, 50_000
#: Bytes of a generation of chunks, what an entry takes beside its bytes, and the longest chunks and pieces that are kept.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 160
LONGEST, LONGEST_PIECE = 1024, 128
#: One of these after letters is a piece of its own.
MARKS = b".,!?"
#: Characters below this one neither combine nor are composed.
COMBINING = "\u0300"
#: Fixed values of the public seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Fixed: the split pattern of the vocabulary file.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class ChunkCache(dict):
    """Chunk bytes -> ids as little-endian uint32.

    A full cache becomes the old generation and is consulted on a miss, so frequent chunks
    outlive the many that occur once; pieces are kept alike. Full is by entries or by bytes, and
    long chunks and pieces aren't kept, so a worker holds some 200 MB at most whatever the texts are.
    """

    def __init__(self, path: str = VOCABULARY) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.find = regex.compile(PIECE).findall
        self.held = 0
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table = {b: chr(b) for b in printable}
        table |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)}
        self.byte_chars = table  # the byte-level alphabet

    def ids(self, p: str) -> bytes:
        """Ids of one piece by the BPE model, uncached."""
        chars = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.byte_chars)
        ids = [t.id for t in self.model.tokenize(chars)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            got = self.old_pieces.get(p)
            if got is None:
                got = self.ids(p)
            if len(p) > LONGEST_PIECE:
                return got
            if len(self.pieces) >= PIECES:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[p] = got
        return got

    def letters(self, low: str, itself: bool) -> bytes:
        """Ids of lower-case letters: ``itself`` if they are the chunk that is missed. Some letters' lower case is beyond ``COMBINING``."""
        return self.ids(low) if itself or max(low) >= COMBINING else self[low.encode()]

    def __missing__(self, chunk: bytes) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            # Bytes are letters only where they are ASCII. A run of letters is one piece, and a chunk of its own.
            if chunk.isalpha():
                low = chunk.lower()
                got = self.ids(low.decode()) if low == chunk else self[low]
            elif chunk[-1] in MARKS and chunk[:-1].isalpha():
                got = self[chunk[:-1].lower()] + self.piece(chr(chunk[-1]))
            else:
                text = chunk.decode()
                if max(text) < COMBINING:
                    low = text.lower()
                    if low.isalpha():
                        got = self.letters(low, low == text)
                    elif low[-1] in ".,!?" and low[:-1].isalpha():
                        got = self.letters(low[:-1], False) + self.piece(low[-1])
                    else:
                        got = b"".join(map(self.piece, self.find(low)))
                else:
                    ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                    got = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) > LONGEST:
            return got
        if len(self) >= CACHE or self.held > CACHE_BYTES:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += len(chunk) + len(got) + ENTRY_BYTES
        self[chunk] = got
        return got

    def encode(self, text: bytes) -> bytes:
        if any(a in text for a in self.added):
            ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, text.split()))


_caches: dict[str, ChunkCache] = {}


def cache_of(path: str) -> ChunkCache:
    """One cache per worker process."""
    if path not in _caches:
        _caches[path] = ChunkCache(path)
    return _caches[path]


class Writer:
    """Writes documents into frames; ``close`` adds index and seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int, int]] = []  # doc_id, is_null, frame, offset, n_tokens
        self.buffer: list[bytes] = []
        self.held = 0
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held + len(ids) > self.frame_bytes:
            self.flush()
        self.index.append((doc_id or 0, doc_id is None, len(self.seek), self.held // 4, len(ids) // 4))
        self.buffer.append(ids)
        self.held += len(ids)
        self.n_tokens += len(ids) // 4

    def flush(self) -> None:
        if self.buffer:
            content = b"".join(self.buffer)
            frame = self.pack.compress(content)
            self.out.write(frame)
            self.seek.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self.buffer, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = np.array(self.index, dtype=INDEX)
        body = self.pack.compress(table.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        entries = b"".join(struct.pack("<III", *e) for e in [*self.seek, (len(body) + 8, 0, 0)])
        foot = struct.pack("<IBI", len(self.seek) + 1, 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(foot)) + entries + foot)


INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "<u1"), ("frame", "<u4"), ("offset", "<u4"), ("n_tokens", "<u4")])


class Reader:
    """Random access by document over a pyarrow input file."""

    def __init__(self, f) -> None:
        self.f = f
        size = f.size()
        n, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        entries = list(struct.iter_unpack("<III", f.read_at(12 * n, size - 9 - 12 * n)))
        self.at = np.concatenate([[0], np.cumsum([e[0] for e in entries])])
        self.entries = entries[:-1]
        body = f.read_at(entries[-1][0] - 8, int(self.at[n - 1]) + 8)
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 31), dtype=INDEX)

    def frame(self, k: int) -> bytes:
        packed, size, check = self.entries[k]
        content = zstandard.ZstdDecompressor().decompress(self.f.read_at(packed, int(self.at[k])), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        return content

    def documents(self, doc_ids: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, tokens of this file before it, ids); decompresses only frames it needs."""
        before, held, content = 0, -1, b""
        for doc_id, is_null, frame, offset, n in self.index.tolist():
            if doc_ids is None or (not is_null and doc_id in doc_ids):
                if frame != held:
                    held, content = frame, self.frame(frame)
                yield (None if is_null else doc_id), before, content[4 * offset : 4 * (offset + n)]
            before += n


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode ``docs`` into files under ``path``; the manifest: file, n_docs, n_tokens, first (tokens before)."""
    spark = docs.sparkSession
    tune(spark)
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(path)
        name, end, cache = f"{root}/part-{part:06d}.ltok", struct.pack("<I", end_id), cache_of(vocabulary)
        temp, n = f"{name}.{attempt}.tmp", 0
        out = writer = None
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if writer is None:
                    out = fs.open_output_stream(temp)
                    writer = Writer(out, frame_bytes)
                writer.add(doc_id, cache.encode(text or b"") + end)
                n += 1
        if writer is not None:
            writer.close()
            out.close()
            if fs.get_file_info(name).type != pafs.FileType.NotFound:  # of an earlier attempt, equal bytes
                fs.delete_file(name)
            fs.move(temp, name)
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"part-{part:06d}.ltok"], "n_docs": [n], "n_tokens": [writer.n_tokens]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    keyed = docs.select("doc_id", "text", fingerprint(F.col("text")).alias("fp"))
    ordered = keyed.repartitionByRange(F.col("doc_id"), F.col("fp")).sortWithinPartitions("doc_id", "fp").select("doc_id", "text")
    files = sorted(ordered.mapInArrow(encode, "part int, file string, n_docs long, n_tokens long").collect())  # a row per file
    rows, before = [], 0
    for f in files:
        rows.append((f.file, f.n_docs, f.n_tokens, before))
        before += f.n_tokens
    return spark.createDataFrame(rows, "file string, n_docs long, n_tokens long, first long")


def scan(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Read all files back: doc_id, start, n_tokens, ids_crc32."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for b in batches:
            for file, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    rows: list[tuple] = []
                    for doc_id, before, ids in Reader(f).documents():
                        rows.append((doc_id, first + before, len(ids) // 4, zlib.crc32(ids)))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    n = max(1, manifest.count())
    return manifest.select("file", "first").repartition(n).mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    return scan(spark, path, write(docs, path))
