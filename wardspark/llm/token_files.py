"""Token ids in seekable files: independent zstandard frames, a trailing seek table, and a checksum for every frame.

A file is a row of frames. Each holds the ids of one document as little-endian unsigned 32-bit integers, or a part of them if there are more than
``FRAME``; frames know nothing of each other. Then come two skippable frames, which plain decompressors pass over: the index (document ids and
numbers of ids, as an Arrow stream) and the seek table of zstandard's published seekable format (compressed size, size and the low 32 bits of XXH64 of every frame,
then the number of frames, a flag and a magic number). A reader fetches the end of a file and the frames of the documents it was asked for, and nothing else.

Documents are in ascending order of their ids over all files; ``manifest.json`` names the files in order, with the number of ids before each. Nulls come first, documents with equal ids in the
order of a hash of their texts. A null or empty text is the end id alone. A task writes under a name of its own attempt, and the manifest names the files of those
attempts that Spark counted, so a task that was lost or ran twice leaves a file that nobody reads. The folder must be one that ``pyarrow.fs`` can open from all executors.
"""

import functools
import io
import itertools
import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardspark.llm.shared import slices, text_key, written

#: Ids in a frame, at most.
FRAME = 1 << 18
#: Bytes in a file, about.
FILE = 32 << 20
#: Characters of a text that are split at a time, longest word that is remembered, words that a Python worker remembers (200 bytes each), bytes that are read at once.
SLICE, LONGEST, REMEMBERED, READ = 1 << 20, 40, 1_200_000, 8 << 20
#: Fixed values of the seekable format: skippable frames of the index and of the seek table, the table's last word, the flag for checksums.
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE, CHECKED = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER = struct.Struct("<IBI")
BLANK = re.compile(r"[ \n]")
#: Words of letters that have one spelling and one lower case: ASCII, Latin-1 and Latin Extended-A without the dotted I.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


class Words(dict):
    """Ids of words as little-endian bytes, worked out when first asked for; all go when there are too many."""

    def __init__(self, library) -> None:
        self.encode, self.merge = library.encode, library.model.tokenize
        normal, cut = library.normalizer, library.pre_tokenizer
        letters = "abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xDF, 0x180)) if PLAIN.fullmatch(c) and c.islower())
        #: How the library spells a letter before it merges; the letters of words that it neither changes nor cuts.
        self.spelt = {ord(c): cut.pre_tokenize_str(normal.normalize_str(c))[0][0] for c in letters}

    def __missing__(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            low = word.lower()
            found = self[low] if low != word else _little([token.id for token in self.merge(word if word.isascii() else word.translate(self.spelt))])
        elif (stem := word.rstrip(".,;:!?")) != word and PLAIN.fullmatch(stem):
            rare = stem not in self
            found = self[stem] + self[word[len(stem) :]]  # a letter and a mark are never in one token
            if rare:
                return found
        else:
            found = _little(self.encode(word, add_special_tokens=False).ids)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def _little(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class WordEncoder:
    """The tokenizers library, asked once for each word.

    Only for tokenizers whose tokens never hold a blank or line end, and which lower-case: then a text's ids are those of its words between them, one after the other. Words of
    plain letters go straight to the library's merges, for it would neither change nor cut them but for their case. The strings of special
    tokens in a text are treated as the library does by itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.words = Words(Tokenizer.from_file(path))

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian bytes, slice by slice."""
        start = 0
        while start < len(text):
            cut = BLANK.search(text, start + SLICE)
            stop = cut.start() if cut else len(text)
            yield b"".join(map(self.words.__getitem__, text[start:stop].replace("\n", " ").split(" ")))
            start = stop


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker: it is loaded once, and keeps the words it knows."""
    return WordEncoder(path)


def frames(ids: Iterator[bytes], frame: int = FRAME) -> Iterator[tuple[bytes, int]]:
    """Compressed frames of at most ``frame`` ids, with the checksums of their contents."""
    press, held = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True), b""
    for part in itertools.chain(ids, [None]):
        held += part or b""
        while held and (part is None or len(held) > 4 * frame):
            body, held = held[: 4 * frame], held[4 * frame :]
            yield press.compress(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF


def encoded(documents: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME) -> DataFrame:
    """Per document: its id, ``tie``, ``n_tokens`` with the end id, ``frames``, the compressed ``sizes`` and the ``sums`` of its frames."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("tie"))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("tie long, n_tokens long, frames binary, sizes array<long>, sums array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer), struct.pack("<I", end_id)
        for batch in slices(batches, 64):
            counts, bodies, sizes, sums = [], [], [], []
            for text in batch.column(1).to_pylist():
                length = 0

                def counted() -> Iterator[bytes]:
                    nonlocal length
                    for part in itertools.chain(encoder.encode(text or ""), [end]):
                        length += len(part) // 4
                        yield part

                found = list(frames(counted(), frame))
                counts.append(length)
                bodies.append(b"".join([body for body, _ in found]))
                sizes.append([len(body) for body, _ in found])
                sums.append([checksum for _, checksum in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(bodies, pa.binary()), pa.array(sizes, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.int64()))], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


def _place(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:])


def _write_file(system: pa.fs.FileSystem, path: str, batches: Iterator[pa.RecordBatch], id_type: pa.DataType, frame: int) -> tuple[int, int]:
    """One file from (id, n_tokens, frames, sizes, sums) rows; documents and ids in it."""
    ids, counts, entries = [], [], []
    with system.open_output_stream(path, compression=None) as out:
        for batch in batches:
            ids.append(batch.column(0))
            counts.append(batch.column(1))
            for count, body, sizes, sums in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                out.write(body)
                entries += [(size, 4 * min(frame, count - i * frame), checksum) for i, (size, checksum) in enumerate(zip(sizes, sums))]
        index = pa.table({"id": pa.chunked_array(ids, id_type), "n_tokens": pa.chunked_array(counts, pa.int64())})
        stream = io.BytesIO()
        with pa.ipc.new_stream(stream, index.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(index)
        skipped = _skippable(INDEX_MAGIC, struct.pack("<I", frame) + stream.getvalue())
        out.write(skipped)
        entries.append((len(skipped), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        out.write(_skippable(TABLE_MAGIC, np.array(entries, "<u4").tobytes() + FOOTER.pack(len(entries), CHECKED, SEEKABLE)))
    return index.num_rows, sum(c.to_numpy().sum() for c in counts)


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE, frame: int = FRAME) -> dict:
    """Writes the files and their manifest, which is returned. The driver sees one line per file."""
    spark = documents.sparkSession
    rows = written(encoded(documents, tokenizer, end_id, id_col, text_col, frame).withColumn("spread", F.monotonically_increasing_id()), "encoded")
    size = rows.agg(F.sum(F.length("frames") + 12 * F.size("sizes"))).first()[0] or 0
    id_type = T.StructType([rows.schema["id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _place(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{uuid.uuid4().hex}.tokens.zst"
        first = next(batches, None)
        if first is None:
            return
        documents, ids = _write_file(system, f"{at}/{name}", (b for b in itertools.chain([first], batches)), first.column(0).type, frame)
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([name]), pa.array([documents], pa.int64()), pa.array([int(ids)], pa.int64())], names=["number", "name", "documents", "ids"])

    system, at = _place(folder)
    system.create_dir(at, recursive=True)
    order = ["id", "tie", "spread"]  # equal rows are told apart, so that a crowd of them can be shared out
    dealt = rows.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)
    files = sorted(dealt.select("id", "n_tokens", "frames", "sizes", "sums").mapInArrow(run, "number int, name string, documents long, ids long").collect())
    starts = list(itertools.accumulate((f.ids for f in files), initial=0))
    manifest = {"format": "seekable zstandard, little-endian uint32", "id": json.loads(id_type.json()), "end_id": end_id, "ids": starts[-1],
                "files": [{"name": f.name, "documents": f.documents, "ids": f.ids, "start": start} for f, start in zip(files, starts)]}
    with system.open_output_stream(f"{at}/manifest.json", compression=None) as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    system, at = _place(folder)
    with system.open_input_stream(f"{at}/manifest.json", compression=None) as lines:
        return json.loads(lines.read())


class TokenFile:
    """One file, opened at its end: where each document's frames are, and no more."""

    def __init__(self, system: pa.fs.FileSystem, path: str) -> None:
        self.handle, self.decompressed = system.open_input_file(path), 0
        size = self.handle.size()
        count, flags, magic = FOOTER.unpack(self.handle.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE or flags != CHECKED:
            raise ValueError(f"{path} has no seek table with checksums")
        start = size - FOOTER.size - 12 * count
        table = np.frombuffer(self.handle.read_at(12 * count, start), "<u4").reshape(count, 3).astype(np.int64)
        self.compressed, self.sizes, self.sums = table.T
        self.offsets = np.concatenate([[0], np.cumsum(self.compressed)])
        index = self.handle.read_at(int(self.compressed[-1]), int(self.offsets[-2]))
        frame = struct.unpack("<I", index[8:12])[0]
        self.index = pa.ipc.open_stream(index[12:]).read_all()
        self.counts = self.index["n_tokens"].to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.first = np.concatenate([[0], np.cumsum(-(-self.counts // frame))])

    def read(self, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The ids, as bytes, of the documents at these places of the index, which are in ascending order; neighbours are fetched together."""
        press = zstandard.ZstdDecompressor()
        ends = np.append(np.flatnonzero(np.diff(places) != 1) + 1, len(places))
        start = 0
        while start < len(places):
            stop = int(ends[np.searchsorted(ends, start, side="right")])
            low = int(self.offsets[self.first[places[start]]])
            limit = np.searchsorted(self.offsets[self.first[places[start:stop] + 1]], low + READ, side="right")
            stop = start + max(1, int(limit))
            raw = memoryview(self.handle.read_at(int(self.offsets[self.first[places[stop - 1] + 1]]) - low, low))
            for place in places[start:stop].tolist():
                parts = []
                for k in range(self.first[place], self.first[place + 1]):
                    body = press.decompress(raw[self.offsets[k] - low : self.offsets[k + 1] - low])
                    self.decompressed += 1
                    if len(body) != self.sizes[k] or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != self.sums[k]:
                        raise ValueError(f"frame {k} is damaged")
                    parts.append(body)
                yield place, b"".join(parts)
            start = stop


def _per_file(spark: SparkSession, manifest: dict) -> DataFrame:
    """(file): the number of every file of the manifest, a task each."""
    count = len(manifest["files"])
    return spark.range(0, count, 1, max(1, count)).select(F.col("id").alias("file"))


def _id_field(manifest: dict, name: str) -> T.StructField:
    return T.StructField(name, T.StructType.fromJson(manifest["id"])["id"].dataType)


def _rows(file: TokenFile, places: np.ndarray, base: int, names: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """(id, start, n_tokens, ids_crc32[, ids]) of some documents, some at a time."""
    held, sums, bodies, size = [], [], [], 0
    for place, raw in itertools.chain(file.read(places), [(-1, b"")]):
        if place >= 0:
            held.append(place)
            sums.append(zlib.crc32(raw))
            size += len(raw)
            if with_ids:
                bodies.append(pa.array(np.frombuffer(raw, "<i4")))
        if held and (place < 0 or len(held) == 4096 or size >= READ):
            at = np.array(held)
            columns = [file.index["id"].take(pa.array(at)).combine_chunks(), pa.array(base + file.starts[at]), pa.array(file.counts[at]), pa.array(sums, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(file.counts[at])]).astype(np.int32)), pa.concat_arrays(bodies)))
            yield pa.RecordBatch.from_arrays(columns, names=names)
            held, sums, bodies, size = [], [], [], 0


def read_tokens(spark: SparkSession, folder: str, wanted: DataFrame | None = None, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """What the files hold: id, ``start`` (ids before the document), ``n_tokens``, ``ids_crc32`` and, with ``with_ids``, ``ids``.

    With ``wanted``, a table with a column of document ids, only those documents are fetched and decompressed: their places are looked up in the files'
    indexes, by a join. Null ids are never wanted.
    """
    manifest = read_manifest(folder)
    files = manifest["files"]
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([_id_field(manifest, id_col), *T.StructType.fromDDL("start long, n_tokens long, ids_crc32 long").fields, *extra])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _place(folder)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                file = TokenFile(system, f"{at}/{files[number]['name']}")
                yield from _rows(file, np.arange(len(file.counts)), files[number]["start"], schema.fieldNames(), with_ids)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _place(folder)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                file = TokenFile(system, f"{at}/{files[number]['name']}")
                for part in file.index.select(["id"]).add_column(1, "place", pa.array(np.arange(len(file.counts)))).to_batches(100_000):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([number] * part.num_rows, pa.int64()), part.column(1)], names=["id", "file", "place"])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _place(folder)
        pairs = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for number, found in itertools.groupby(pairs, lambda pair: pair[0]):
            file = TokenFile(system, f"{at}/{files[number]['name']}")
            while chosen := [place for _, place in itertools.islice(found, 100_000)]:
                yield from _rows(file, np.array(chosen), files[number]["start"], schema.fieldNames(), with_ids)

    if wanted is None:
        return _per_file(spark, manifest).mapInArrow(whole, schema)
    index = _per_file(spark, manifest).mapInArrow(places, T.StructType([_id_field(manifest, "id"), *T.StructType.fromDDL("file long, place long").fields]))
    asked = wanted.select(F.col(id_col).alias("id")).distinct()
    found = index.join(asked, "id", "left_semi").select("file", "place")
    return found.repartitionByRange("file", "place").sortWithinPartitions("file", "place").mapInArrow(some, schema)
