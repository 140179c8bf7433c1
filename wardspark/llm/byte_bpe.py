"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are first cut at places where no match of the splitting pattern can reach across, so that the library never
holds the ids of a whole text; the ids of the pieces, one after the other, are those of the whole text. Decoding goes by
raw bytes, so ids that split a character lose nothing.

Null counts as the empty text: no ids, and the hashes of nothing. Rows are independent of each other; no shuffle.
"""

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, types as T

from wardspark.llm.shared import slices

#: Characters in a piece of a long text, at least.
PIECE = 1 << 16
#: A letter or digit before a blank or line end. No match of the pattern holds white space after another character, so a
#: match ends here, and the match after it begins with the blank.
SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")


@functools.cache
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The tokenizer, loaded once in a Python worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name=rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _decimals(n_vocab: int) -> list[str]:
    return [str(i) for i in range(n_vocab)]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text, cut only at safe places, into pieces of ``size`` characters or a little more."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoder: tiktoken.Encoding, text: str, size: int = PIECE) -> Iterator[list[int]]:
    for piece in pieces(text, size):
        yield encoder.encode_ordinary(piece)


def encode(documents: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Token counts and digests per document, and the ids themselves if asked for.

    Columns: the id, ``keep``, ``n_tokens``, ``ids_sha256`` (of decimal ids with blanks between), ``decoded_sha256`` (of the bytes the
    ids decode to) and, with ``with_ids``, ``ids``.
    """
    rows = documents.select(id_col, *keep, text_col)
    passed = [rows.schema[c] for c in (id_col, *keep)]
    own = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(passed + own + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(rank_file, pattern)
        names = _decimals(encoder.n_vocab)
        for batch in slices(batches, 64):
            counts, hashes, decoded, tokens = [], [], [], []
            for text in batch.column(len(passed)).to_pylist():
                count, joined, raw, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in encode_text(encoder, text or ""):
                    if ids:
                        joined.update(((" " if count else "") + " ".join([names[i] for i in ids])).encode())
                        raw.update(encoder.decode_bytes(ids))
                        count += len(ids)
                        if with_ids:
                            kept.append(pa.array(ids, pa.int32()))
                counts.append(count)
                hashes.append(joined.hexdigest())
                decoded.append(raw.hexdigest())
                tokens.append(pa.concat_arrays(kept) if kept else pa.array([], pa.int32()))
            columns = [batch.column(i) for i in range(len(passed))] + [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                ends = [0]
                for t in tokens:
                    ends.append(ends[-1] + len(t))
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(tokens) if tokens else pa.array([], pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes that ids stand for, per document; null ids count as none."""
    rows = encoded.select(id_col, ids_col)
    schema = T.StructType([rows.schema[id_col], T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(rank_file, pattern)
        for batch in slices(batches, 64):
            raw = [encoder.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
