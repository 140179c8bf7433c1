import itertools
import json
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus import LONG, TEXTS, documents, plain
from wardspark.llm import token_files as tf
from wardspark.llm.token_files import TokenFile, read_manifest, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = TEXTS + [(30, "don't  stop\n\n  now\t x y　z  12 34five <|endoftext|> 🙂🙃 é ́a ΣΑΣ Σ İ ﬁ\x1cx\x85y"), (31, "a b c " * 40_000), (32, "x" * 5000 + " y"), (-4, "first of all")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_have_the_ids_of_the_whole_text(library, monkeypatch):
    monkeypatch.setattr(tf, "SLICE", 50)
    monkeypatch.setattr(tf, "REMEMBERED", 20)
    encoder = tf.WordEncoder(PATH)
    plain_letters = "".join(f" x{chr(c)} {chr(c)}y, {chr(c)}" for c in [*range(0x20, 0x250), 0x3A3, 0x3C2, 0x1E9E, 0x212A, 0xFB01])
    marks = "J\u030c j\u030c e\u0301 E\u0301 <\u0338 a<\u0338 a,\u0338 W\u030a wo.\u0301 don't. it's, 'S, I'M! a.b a... ?! 'quoted.' x;; Straße, ÉTÉ. œuvre ĲSSEL ŉ ſ ı İ"
    for _, text in [*ROWS, (0, None), (0, plain_letters), (0, marks), (0, marks * 50)]:
        assert np.frombuffer(b"".join(encoder.encode(text or "")), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file_bytes, frame", [(1 << 25, 1 << 18), (2000, 1000), (1, 7)])
def test_files_hold_what_the_library_gives(spark, tmp_path, library, file_bytes, frame):
    folder = f"file://{tmp_path}/tokens"
    manifest = write_tokens(documents(spark, ROWS), folder, PATH, 2, file_bytes=file_bytes, frame=frame)
    found = read_tokens(spark, folder, with_ids=True).collect()
    assert plain((r.doc_id, r.ids) for r in found) == plain((doc, ids_of(library, text)) for doc, text in ROWS)
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)
    in_order = sorted(found, key=lambda r: r.start)
    assert [r.start for r in in_order] == list(itertools.accumulate((r.n_tokens for r in found and in_order), initial=0))[:-1]
    ids = [r.doc_id for r in in_order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and manifest["ids"] == sum(r.n_tokens for r in found)
    assert file_bytes > 2000 or len(manifest["files"]) > 3
    assert read_manifest(folder) == json.loads(json.dumps(manifest, default=int))


def test_standard_decompressors_read_the_frames(spark, tmp_path, library):
    write_tokens(documents(spark, ROWS), str(tmp_path), PATH, 2, frame=500)
    manifest = read_manifest(str(tmp_path))
    raw = b"".join(zstandard.ZstdDecompressor().stream_reader((tmp_path / f["name"]).read_bytes(), read_across_frames=True).read() for f in manifest["files"])
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(raw) == 4 * manifest["ids"] and raw.endswith(np.array(ids_of(library, ordered[-1][1]), "<u4").tobytes())
    tail = (tmp_path / manifest["files"][0]["name"]).read_bytes()
    count, flags, magic = struct.unpack("<IBI", tail[-9:])
    assert (flags, magic) == (0x80, 0x8F92EAB1)
    assert struct.unpack("<II", tail[-9 - 12 * count - 8 : -9 - 12 * count]) == (0x184D2A5E, 12 * count + 9)


def test_only_asked_documents_are_decompressed(spark, tmp_path, library, monkeypatch):
    write_tokens(documents(spark, ROWS), str(tmp_path), PATH, 2)
    wanted = documents(spark, [(5, ""), (5, ""), (30, ""), (99, ""), (None, "")])
    found = read_tokens(spark, str(tmp_path), wanted, with_ids=True).collect()
    assert plain((r.doc_id, r.ids) for r in found) == plain((doc, ids_of(library, text)) for doc, text in ROWS if doc in (5, 30))
    file = TokenFile(pa.fs.LocalFileSystem(), str(tmp_path / read_manifest(str(tmp_path))["files"][0]["name"]))
    monkeypatch.setattr(tf, "READ", 100)
    assert len(list(file.read(np.array([1, 4, 5])))) == 3 and file.decompressed == 3


def test_damage_is_noticed(spark, tmp_path):
    write_tokens(documents(spark, ROWS), str(tmp_path), PATH, 2)
    path = tmp_path / read_manifest(str(tmp_path))["files"][0]["name"]
    raw = bytearray(path.read_bytes())
    file = TokenFile(pa.fs.LocalFileSystem(), str(path))
    at = int(file.offsets[-2] - 30)  # in the last frame
    raw[at] ^= 1
    path.write_bytes(bytes(raw))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(TokenFile(pa.fs.LocalFileSystem(), str(path)).read(np.arange(len(file.counts))))


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    write_tokens(documents(spark, ROWS), str(tmp_path), PATH, 2)
    (tmp_path / "part-000000-lost.tokens.zst").write_bytes(b"half a file")
    assert read_tokens(spark, str(tmp_path)).count() == len(ROWS)


def test_empty_table_and_a_crowd_of_equal_rows(spark, tmp_path):
    assert write_tokens(documents(spark, []), str(tmp_path / "none"), PATH, 2)["files"] == []
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0
    crowd = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(LONG[:2000]).alias("text"))
    manifest = write_tokens(crowd, str(tmp_path / "crowd"), PATH, 2, file_bytes=100_000)
    assert len(manifest["files"]) >= 3 and max(f["documents"] for f in manifest["files"]) < 2000
    assert read_tokens(spark, str(tmp_path / "crowd")).groupBy("n_tokens", "ids_crc32").count().count() == 1
