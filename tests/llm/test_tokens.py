"""Token files and byte-level BPE against the public libraries."""

import hashlib
import io
import random
import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import tiktoken
from tokenizers import Tokenizer

from ledgerlight.llm import bytebpe, tokenfile

ALPHABET = "aZ sS'tTrevVmMlLdD  \n\t\r\u000b\u0085  .,!#é́ÀßİΣσς中文١٢3½😀​\u001c<|endoftext|>-_ "


def odd_texts(n: int = 400) -> list[str]:
    r = random.Random(7)
    out = ["", " ", "  ", "\n", "'s", " 's", "''s", "don't 'll 're\n've  'x'd's't", "a  b", "a \n b  ", "  \n", "x'", "'", "'l", "'r", "'ve'", "ÀÉ’s"]
    out += ["".join(r.choice(ALPHABET) for _ in range(r.randrange(1, 60))) for _ in range(n)]
    out.append("word " * 30_000)
    return out


@pytest.fixture(scope="module")
def tk():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def test_chunk_cache_equals_library(tk):
    cache = tokenfile.ChunkCache()
    for t in odd_texts():
        want = tk.encode(t, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(want)}I", cache.encode(t.encode()))) == want, repr(t)


def test_byte_bpe_equals_library_and_round_trips():
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.ranks(), special_tokens={})
    cache = bytebpe.PieceCache()
    texts = odd_texts()
    ids, offsets = bytebpe.encode_texts([t.encode() for t in texts], cache)
    for t, i, o in zip(texts, ids, offsets, strict=True):
        want = enc.encode_ordinary(t)
        got = list(struct.unpack(f"<{len(i) // 4}I", i))
        assert got == want, repr(t)
        assert b"".join(cache.bytes_of[k] for k in got) == t.encode()
        assert len(o) // 4 <= max(1, len(t)) and (not t or struct.unpack("<I", o[:4]) == (0,))


def test_plain_pair_merging_equals_library():
    table, cache = bytebpe.ranks(), bytebpe.PieceCache()
    r = random.Random(3)
    for _ in range(200):
        piece = "".join(r.choice("thensouéß中") for _ in range(r.randrange(1, 14))).encode()
        assert bytebpe.merge_pairs(piece, table) == cache.merge(piece)


def test_file_reads_only_needed_frames_and_checks_them():
    sink = io.BytesIO()
    w = tokenfile.Writer(sink, frame_bytes=64)
    docs = [(None, b"\x07\0\0\0"), *((i, struct.pack("<3I", i, i + 1, 1)) for i in range(50)), (50, struct.pack("<100I", *range(100)))]
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    data = sink.getvalue()
    r = tokenfile.Reader(pa.BufferReader(data))
    assert [(d, ids) for d, _, ids in r.documents()] == docs
    opened = []
    frame = r.frame
    r.frame = lambda k: (opened.append(k), frame(k))[1]
    assert [(d, n) for d, n, _ in r.documents({7, 50})] == [(7, 22), (50, 151)]
    assert len(opened) == 2
    broken = bytearray(data)
    broken[12] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        list(tokenfile.Reader(pa.BufferReader(bytes(broken))).documents())


ROWS = [(3, "B b", "x"), (1, None, "y"), (2, "", None), (None, "null id", "z"), (5, "don't  stop\n", "x"), (5, "don't  stop\n", "x"), (9, "é" * 3000, "q")]


def test_op1_rows(spark, tk):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string").repartition(3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.token_files(docs).collect())
    want, at = [], 0
    for d, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((at, d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == want
    assert tokenfile.token_files(docs.limit(0)).count() == 0


def test_written_files_are_whole(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    path = f"file://{tmp_path}/t"
    m = tokenfile.write(docs, path).collect()
    fs, root = pafs.FileSystem.from_uri(path)
    assert sorted(f.file for f in m) == sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(root)))


def test_op8_rows(spark):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.ranks(), special_tokens={})
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.digests(docs).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t, _ in ROWS:
        ids = enc.encode_ordinary(t or "")
        want.append((d or -1, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode())))
    assert got == sorted(want)
    assert bytebpe.digests(docs.limit(0)).count() == 0
