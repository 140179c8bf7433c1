import hashlib

import public_tokenizers
import pytest

from corpus import TEXTS, documents, plain
from wardspark.llm.byte_bpe import decode, encode, encode_text, encoding

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ROWS = TEXTS + [(30, "don't  stop\n\n  now\t x    y 12 34five <|endoftext|> 🙂🙃 　z"), (31, "a b c " * 30_000)]


def test_equals_the_library(spark):
    library = encoding(PATH, PATTERN)
    expected = []
    for doc, text in ROWS:
        ids = library.encode_ordinary(text or "")
        expected.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert plain(encode(documents(spark, ROWS), PATH, PATTERN).collect()) == plain(expected)


@pytest.mark.parametrize("size", [1, 5, 100])
def test_pieces_have_the_ids_of_the_whole(size):
    library = encoding(PATH, PATTERN)
    for _, text in ROWS:
        assert [i for piece in encode_text(library, text or "", size) for i in piece] == library.encode_ordinary(text or "")


def test_round_trip(spark):
    encoded = encode(documents(spark, ROWS), PATH, PATTERN, keep=("lang",), with_ids=True)
    assert plain((r.doc_id, bytes(r.bytes)) for r in decode(encoded, PATH, PATTERN).collect()) == plain((i, (t or "").encode()) for i, t in ROWS)
    assert encode(documents(spark, []), PATH, PATTERN).count() == 0
