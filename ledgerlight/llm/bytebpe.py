"""Byte-level BPE: encoding and decoding with retained offsets.

Pre-tokenisation uses no regex. Code points become classes (letter, number, white
space, other) by a table. Each position is a function on the state "start of the
current run": a class change sets it, anything else keeps it. These functions compose
associatively, so one prefix scan (``maximum.accumulate``) over a whole batch of
documents gives every run's start, and with it its length; the pattern's look-ahead and
contractions are then local rules on runs. The slices go through a cache of merged
pieces; the pair merging itself is the library's, ``merge_pairs`` is the plain
form it is tested against.

Edge cases: null and empty texts have no tokens; repeated rows each get a row;
extra columns are ignored; an empty table gives no rows. Texts over an Arrow batch's
share are processed whole.

Memory: ``digests`` encodes and decodes in one Python stage, in groups of about
``GROUP_BYTES`` of text; the piece cache is bounded in bytes and emptied when a task ends, so an
idle worker holds no more than the vocabulary.
"""

from __future__ import annotations

import base64
import struct
import sys
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlight.llm.common import tune

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of pieces and ids that a cache may hold, with about 160 bytes of overhead an entry.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 160
#: Text taken through the scan at once.
GROUP_BYTES = 4 << 20
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Fixed: code points with the White_Space property.
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_tables: dict[str, object] = {}


def classes() -> np.ndarray:
    """Class of every code point, built once per worker from the general categories."""
    if "classes" not in _tables:
        kind = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
        t[list(WHITE_SPACE)] = SPACE
        _tables["classes"] = t
    return _tables["classes"]


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_starts(points: np.ndarray, doc_first: np.ndarray) -> np.ndarray:
    """Positions, in code points, where a token starts; ``doc_first`` marks first positions."""
    n = len(points)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    cls = classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[doc_first[doc_first < n]] = True
    first[0] = first[n] = True
    change = first.copy()
    change[1:n] |= cls[1:] != cls[:-1]
    # Prefix scan of set-or-keep functions: the run each position is in.
    run_start = np.maximum.accumulate(np.where(change[:n], np.arange(n), 0))
    start = change[:n].copy()
    # A run of white space before a word gives up its last character.
    word = np.flatnonzero(change[:n] & ~first[:n] & (cls != SPACE))
    word = word[cls[word - 1] == SPACE]
    start[word - 1] = True
    joined = word[points[word - 1] == 0x20]
    start[joined] = False
    # Contractions: an apostrophe that starts a token and is a run of its own.
    at = np.flatnonzero((points == 0x27) & start)
    at = at[at + 1 < n]
    at = at[(cls[at + 1] == LETTER) & ~first[at + 1] & (run_start[at] == at)]
    if len(at):
        a = points[at + 1]
        has_two = (at + 2 < n) & ~first[np.minimum(at + 2, n)]
        b = np.where(has_two, points[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, k in ((at[one], 2), (at[two], 3)):
            start[hit + 1] = False
            after = hit[hit + k < n] + k
            start[after[(cls[after] == LETTER)]] = True
    return np.flatnonzero(start)


def merge_pairs(piece: bytes, table: dict[bytes, int]) -> list[int]:
    """Plain pair merging: the lowest-ranked neighbours first, the leftmost of equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (table.get(parts[i] + parts[i + 1], sys.maxsize), i))
        if parts[best] + parts[best + 1] not in table:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [table[p] for p in parts]


class PieceCache(dict):
    """Piece bytes -> ids as little-endian uint32; emptied when it holds ``CACHE_BYTES``."""

    def __init__(self, path: str = VOCABULARY) -> None:
        super().__init__()
        import tiktoken

        table = ranks(path)
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for k, v in table.items():
            self.bytes_of[v] = k
        self.width = np.array([len(t) for t in self.bytes_of])
        self.held = 0
        self.merge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})._encode_single_piece

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.merge(piece)
        got = struct.pack(f"<{len(ids)}I", *ids)
        self.held += len(piece) + len(got) + ENTRY_BYTES
        if self.held > CACHE_BYTES:
            self.drop()
        self[piece] = got
        return got

    def drop(self) -> None:
        self.clear()
        self.held = 0


def cache_of(path: str) -> PieceCache:
    """The worker's cache; whoever takes it drops its pieces when the task ends."""
    if path not in _tables:
        _tables[path] = PieceCache(path)
    return _tables[path]


def grouped(texts: Iterator[bytes], most: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    """Lists of texts of about ``most`` bytes; a longer text is a list of its own."""
    group, held = [], 0
    for t in texts:
        if group and held + len(t) > most:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def encode_texts(texts: list[bytes], cache: PieceCache) -> tuple[list[bytes], list[bytes]]:
    """ids and piece offsets (bytes into the text), both packed as uint32, per text."""
    whole = b"".join(texts)
    points = np.frombuffer(whole.decode().encode("utf-32-le"), dtype=np.uint32)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    byte_at = np.concatenate([[0], np.cumsum(width)])
    ends = np.cumsum([len(t) for t in texts])
    firsts = np.searchsorted(byte_at, np.concatenate([[0], ends[:-1]])) if texts else np.zeros(0, dtype=np.int64)
    at = byte_at[token_starts(points, firsts)]
    bounds = np.searchsorted(at, ends)
    ids, offsets, lo, base = [], [], 0, 0
    get = cache.__getitem__
    for hi, end in zip(bounds.tolist(), ends.tolist(), strict=True):
        own = at[lo:hi]
        cut = own.tolist()
        cut.append(end)
        ids.append(b"".join([get(whole[s:e]) for s, e in zip(cut, cut[1:])]))
        offsets.append((own - base).astype("<u4").tobytes())
        lo, base = hi, end
    return ids, offsets


SCHEMA = "doc_id long, n_bytes long, ids binary, piece_offsets binary"


def bodies(column: pa.Array) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in column.cast(pa.binary()))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, ids and piece_offsets (packed little-endian uint32)."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(vocabulary)
        try:
            for b in batches:
                sizes, ids, offsets = [], [], []
                for texts in grouped(bodies(b.column(1))):
                    got = encode_texts(texts, cache)
                    sizes += map(len, texts)
                    ids += got[0]
                    offsets += got[1]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())], names=["doc_id", "n_bytes", "ids", "piece_offsets"])
        finally:
            cache.drop()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def decoded_bytes(ids: bytes, offsets: bytes, size: int, cache: PieceCache) -> bytes:
    """The text's bytes; pieces must end where their offsets say."""
    i = np.frombuffer(ids, dtype="<u4")
    ends = np.cumsum(cache.width[i])
    starts = np.frombuffer(offsets, dtype="<u4")
    if (int(ends[-1]) if len(ends) else 0) != size or not np.isin(starts[1:], ends).all():
        raise ValueError("ids and offsets disagree")
    return b"".join(map(cache.bytes_of.__getitem__, i.tolist()))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with ``decoded`` (the bytes)."""
    tune(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(vocabulary)
        for b in batches:
            rows = zip(b.column("ids"), b.column("piece_offsets"), b.column("n_bytes"), strict=True)
            out = [decoded_bytes(i.as_py(), o.as_py(), n.as_py(), cache) for i, o, n in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, SCHEMA + ", decoded binary")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(vocabulary)
        try:
            for b in batches:
                counts, of_ids, of_text = [], [], []
                for texts in grouped(bodies(b.column(1))):
                    for t, ids, offsets in zip(texts, *encode_texts(texts, cache), strict=True):
                        counts.append(len(ids) // 4)
                        of_ids.append(sha256(ids).hexdigest())
                        of_text.append(sha256(decoded_bytes(ids, offsets, len(t), cache)).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            cache.drop()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
