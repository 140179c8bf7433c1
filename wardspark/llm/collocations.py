"""Collocations by vertically partitioned, depth-truncated suffix trees.

The suffixes of a corpus that start with the same words make up one subtree, so subtrees can be built apart from each other once it is known
how many suffixes each prefix has. The corpus is read once for the counts of single words; prefixes with more suffixes than the
memory budget are extended by a word and counted again, until every prefix fits or is as long as the tree is deep. Prefixes are then
packed into groups of at most the budget. A last reading cuts every suffix at the depth of the tree (and before words that are too rare to be
part of any result), counts equal ones on the spot, and sends them to their group as packed leaf tables. Each group merges its leaves
and reads the count of every node off the sums of the leaves below it.

While prefixes are packed, they are known by 64-bit hashes and counted per bucket of hashes, so all tables are of a fixed size; a clash only puts two
prefixes into one group, or extends one that need not be. Counts go by the words themselves. A prefix that is extended lies in several groups; their
parts of its count are added up at the end. Buckets of full-length prefixes, which have nothing to extend, are cut into as many groups as the budget asks for.

Words and pieces: A-Z are lowered, ``[.,;:!?]`` and line ends end a piece, blanks and tabs part the words of one. Null texts and texts
without words count nothing; a null language is ``und``. Repeated rows count as often as they stand there, whatever their ids. Very long texts are cut into slices
between words, and phrases across two slices are counted like all others. An empty table gives an empty result. Other columns are not read.
"""

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from wardspark.llm.shared import slices, written

#: What stands between pieces; no word holds it.
END = b"."
#: Lowers A-Z, makes tabs blanks and whatever ends a piece ``END``.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz " + END * 9)
#: Suffixes that a group holds.
BUDGET = 500_000
#: Words that a task counts at a time, and bytes of a text that it splits at a time.
CHUNK, SLICE = 2_000_000, 4 << 20
#: Bits of the table of words that may be frequent, and of the tables from prefixes to groups.
WORD_BITS, BITS = 21, 16
#: Words that are turned into numbers at a time.
CODED = 200_000
UNKNOWN, SEED = "und", 42


@dataclass
class Chunk:
    """Words of one language in the order of the texts, as numbers from 1; 0 stands between pieces."""

    lang: str
    words: list[bytes]
    hashes: np.ndarray
    stream: np.ndarray
    starts: int

    def ahead(self, by: int) -> np.ndarray:
        """For every start, the word so many places on."""
        return self.stream[by : by + self.starts]


def _slices(text: bytes, size: int) -> Iterator[bytes]:
    start = 0
    while len(text) - start > size:
        cuts = [at for at in (text.find(b" ", start + size), text.find(END, start + size)) if at >= 0]
        if not cuts:
            break
        yield text[start : min(cuts)]
        start = min(cuts)
    yield text[start:]


def _tokens(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """Words and piece ends of a text, and one more end."""
    for part in _slices(text.translate(PLAIN), size):
        yield part.replace(END, b" . ").split()
    yield [END]


def chunks(batches: Iterator[pa.RecordBatch], depth: int, size: int = CHUNK, part: int = SLICE) -> Iterator[Chunk]:
    """The texts of (language, text) batches as chunks; the last ``depth - 1`` words of one come again at the head of the next."""
    held: dict[str, list[pa.DictionaryArray]] = defaultdict(list)
    fresh: dict[str, list[bytes]] = defaultdict(list)
    counts: dict[str, int] = defaultdict(int)

    def code(lang: str) -> None:
        held[lang].append(pa.array(fresh.pop(lang, []), pa.binary()).dictionary_encode())

    def emptied(lang: str, last: bool) -> Chunk:
        fresh[lang] += [END] * (depth - 1) * last
        code(lang)
        counts.pop(lang)
        coded = pa.chunked_array(held.pop(lang)).unify_dictionaries()
        words = coded.chunk(0).dictionary.to_pylist()
        stream = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
        number, found = np.arange(1, len(words) + 1), words.index(END) if END in words else None
        if found is not None:
            number[found] = 0
            number[found + 1 :] -= 1
            del words[found]
        stream = number[stream]
        if not last:
            tail = [END if i == 0 else words[i - 1] for i in stream[len(stream) - depth + 1 :]] if depth > 1 else []
            fresh[lang] += tail
            counts[lang] = len(tail)
        seed = xxhash.xxh64_intdigest(lang, seed=SEED)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed=seed) for w in words), np.uint64, len(words))
        return Chunk(lang, words, np.concatenate([np.zeros(1, np.uint64), hashes]), stream, max(0, len(stream) - depth + 1))

    for batch in slices(batches, 128):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        for i, lang in enumerate(langs):
            lang = UNKNOWN if lang is None else lang
            for tokens in _tokens(texts[i].as_py() or b"", part):
                fresh[lang] += tokens
                counts[lang] += len(tokens)
                if len(fresh[lang]) >= CODED:
                    code(lang)
                if sum(counts.values()) >= size:
                    for full in [k for k in counts if counts[k] >= depth]:
                        yield emptied(full, False)
    for lang in list(counts):
        yield emptied(lang, True)


def mixed(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a prefix made one word longer."""
    with np.errstate(over="ignore"):
        x = (prefix ^ (word * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _bucket(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Partition:
    """``common``: whether a word with this hash may be frequent. Per length of a prefix, by bucket: ``hot``, whether it was extended; the group it ``starts`` at
    and the number of groups (``ways``) it is shared out to."""

    common: np.ndarray
    hot: list[np.ndarray]
    starts: list[np.ndarray]
    ways: list[np.ndarray]

    def may_be_frequent(self, hashes: np.ndarray) -> np.ndarray:
        return self.common[_bucket(hashes, WORD_BITS)]

    def is_hot(self, length: int, hashes: np.ndarray) -> np.ndarray:
        return self.hot[length - 1][_bucket(hashes)] if length <= len(self.hot) else np.zeros(len(hashes), bool)

    def group(self, length: int, hashes: np.ndarray) -> np.ndarray:
        bucket = _bucket(hashes)
        return self.starts[length - 1][bucket] + (hashes % self.ways[length - 1][bucket].astype(np.uint64)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), and the number of all words under a null word."""
    for chunk in chunks(batches, 1, size):
        counts = np.bincount(chunk.stream, minlength=len(chunk.words) + 1)[1:]
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk.lang] * (len(chunk.words) + 1)), pa.array([None, *chunk.words], pa.binary()).cast(pa.string()), pa.array([int(counts.sum()), *counts.tolist()], pa.int64())],
            names=["lang", "word", "n"])


def word_counts(texts: DataFrame, min_count: int, size: int = CHUNK) -> DataFrame:
    """(lang, word, n) of all words with ``min_count`` occurrences; with a null word, the number of all words of the language."""
    found = texts.mapInArrow(lambda batches: _tally(batches, size), "lang string, word string, n long")
    return written(found.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= min_count)), "words")


def _extended(chunk: Chunk, partition: Partition, level: int) -> np.ndarray:
    """The hashes of all prefixes that are one word longer than an extended one of ``level`` words."""
    at = np.flatnonzero(partition.is_hot(1, chunk.hashes)[chunk.ahead(0)] & (chunk.ahead(0) > 0))
    hashes, common = chunk.hashes[chunk.stream[at]], _common(chunk, partition)
    for length in range(1, level + 1):
        following = chunk.stream[at + length]
        go = partition.is_hot(length, hashes) & common[following]
        at, hashes = at[go], mixed(hashes[go], chunk.hashes[following[go]])
    return hashes


def _common(chunk: Chunk, partition: Partition) -> np.ndarray:
    """By number, whether a word may be frequent; ends of pieces are not."""
    common = partition.may_be_frequent(chunk.hashes)
    common[0] = False
    return common


def _longer(texts: DataFrame, partition: Partition, level: int, depth: int, size: int) -> DataFrame:
    """(bucket, n): suffixes by bucket of their prefix, of those prefixes that are one word longer than the extended ones. A task gives a row per bucket at most."""
    shared = texts.sparkSession.sparkContext.broadcast(partition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int64)
        for chunk in chunks(batches, depth, size):
            counts += np.bincount(_bucket(_extended(chunk, shared.value, level)), minlength=1 << BITS)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _weights(counts: DataFrame) -> np.ndarray:
    """(bucket, n) as an array; one row for each bucket at most."""
    found, weights = counts.toArrow(), np.zeros(1 << BITS, np.int64)
    weights[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return weights


def _common_words(hashes: DataFrame) -> np.ndarray:
    """Which buckets hold a word of the table: 2^21 bits, put together by Spark in pieces of 4 KB."""
    number = F.shiftrightunsigned("hash", 64 - WORD_BITS) + 1
    pieces = hashes.groupBy(F.bitmap_bucket_number(number).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")).toArrow()
    common = np.zeros(1 << WORD_BITS, bool)
    for piece, bits in zip(pieces["piece"].to_pylist(), pieces["bits"].to_pylist()):
        found = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        common[(piece - 1) * len(found) : piece * len(found)] = found
    return common


def partition_prefixes(texts: DataFrame, words: DataFrame, depth: int, budget: int = BUDGET, size: int = CHUNK) -> Partition:
    """Counts prefixes, longer ones where a bucket is over the budget, and packs them into groups. The driver sees sums per bucket only."""
    hashed = words.where("word IS NOT NULL").select(F.xxhash64("lang", "word").alias("hash"), "n")
    weights = [_weights(hashed.groupBy(F.shiftrightunsigned("hash", 64 - BITS).alias("bucket")).agg(F.sum("n").alias("n")))]
    partition = Partition(_common_words(hashed), [], [], [])
    while len(weights) < depth and (weights[-1] > budget).any():
        partition.hot.append(weights[-1] > budget)
        weights.append(_weights(_longer(texts, partition, len(weights), depth, size)))
    flat = np.concatenate(weights)
    hot = np.concatenate([*partition.hot, np.zeros(1 << BITS, bool)])
    ways = np.maximum(1, -(-np.where(hot, 0, flat) // budget))
    small = ways == 1
    starts = np.cumsum(np.where(hot | ~small, 0, flat)) // budget
    starts[~small] = starts[-1] + 1 + np.cumsum(ways[~small]) - ways[~small]
    partition.starts, partition.ways = np.split(starts, len(weights)), np.split(ways, len(weights))
    return partition


def _groups(columns: list[np.ndarray], chunk: Chunk, partition: Partition) -> np.ndarray:
    """The group of every leaf: that of its shortest prefix that was not extended; a leaf that ends before goes by what there is of it."""
    hashes = chunk.hashes[columns[0]]
    found = partition.group(1, hashes)
    at = np.arange(len(found))
    for length, column in enumerate(columns[1:], 2):
        go = partition.is_hot(length - 1, hashes) & (column[at] > 0)
        at, hashes = at[go], mixed(hashes[go], chunk.hashes[column[at[go]]])
        if not len(at):
            break
        found[at] = partition.group(length, hashes)
    return found


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each path of words, in the order of the words' numbers."""
    keys, reach = columns[0], int(columns[0].max(initial=0)) + 1
    for column in columns[1:]:
        wide = int(column.max(initial=0)) + 1
        if reach * wide >= 1 << 62:
            found, keys = np.unique(keys, return_inverse=True)
            reach = len(found)
        keys, reach = keys * wide + column, reach * wide
    return keys


def merged(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal leaves as one, in the order of their words' numbers."""
    keys = _keys(columns)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[order], first) if len(keys) else counts
    return [column[order[first]] for column in columns], sums


def nodes(columns: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Per depth from two words on, the paths of the subtree's nodes and the sums of the leaves below them. Leaves are in the order of their paths."""
    paths = columns[0]
    for depth in range(2, len(columns) + 1):
        there = columns[depth - 1] > 0
        columns, counts, paths = [c[there] for c in columns], counts[there], paths[there]
        if not len(counts):
            return
        steps = np.concatenate([[True], (paths[1:] != paths[:-1]) | (columns[depth - 1][1:] != columns[depth - 1][:-1])])
        first, paths = np.flatnonzero(steps), np.cumsum(steps)
        yield [c[first] for c in columns[:depth]], np.add.reduceat(counts, first)


def _packed(words: list[bytes], columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    used = np.unique(np.concatenate(columns))
    used = used[used > 0]
    own = [np.where(c > 0, np.searchsorted(used, c) + 1, 0).astype(np.min_scalar_type(len(used))) for c in columns]
    counts = counts.astype(np.min_scalar_type(int(counts.max())))
    return zstandard.compress(pickle.dumps((b" ".join([words[i - 1] for i in used]), [c.tobytes() for c in own], own[0].dtype.str, counts.tobytes(), counts.dtype.str), 5), 1)


def _unpacked(raw: bytes) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    words, columns, kind, counts, count_kind = pickle.loads(zstandard.decompress(raw))
    return words.split(b" "), [np.frombuffer(c, kind).astype(np.int64) for c in columns], np.frombuffer(counts, count_kind).astype(np.int64)


def _leaves(texts: DataFrame, partition: Partition, depth: int, size: int) -> DataFrame:
    """(group, lang, leaves): what a chunk has for a group, as one packed table."""
    shared = texts.sparkSession.sparkContext.broadcast(partition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = shared.value
        for chunk in chunks(batches, depth, size):
            common = _common(chunk, partition)
            number = np.where(common, np.arange(len(common)), 0)[chunk.stream]
            starts = np.flatnonzero((number[: chunk.starts] > 0) & (number[1 : 1 + chunk.starts] > 0))
            columns = [number[starts], number[starts + 1]]
            for by in range(2, depth):
                columns.append(np.where(columns[-1] > 0, number[starts + by], 0))
            columns, counts = merged(columns, np.ones(len(starts), np.int64))
            group = _groups(columns, chunk, partition)
            order = np.argsort(group, kind="stable")
            group, columns, counts = group[order], [c[order] for c in columns], counts[order]
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            for start, stop in zip(cuts, [*cuts[1:], len(group)]):
                leaves = _packed(chunk.words, [c[start:stop] for c in columns], counts[start:stop])
                yield pa.RecordBatch.from_arrays([pa.array([int(group[start])]), pa.array([chunk.lang]), pa.array([leaves], pa.binary())], names=["group", "lang", "leaves"])

    return texts.mapInArrow(run, "group long, lang string, leaves binary")


class Subtree:
    """The leaves of one group and language."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.tables: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.rows = self.merged = 0

    def add(self, raw: bytes) -> None:
        words, columns, counts = _unpacked(raw)
        own = np.array([0, *(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)])
        self.tables.append(([own[c] for c in columns], counts))
        self.rows += len(counts)
        if self.rows > 2 * self.merged + BUDGET:
            self.merge()

    def merge(self) -> tuple[list[np.ndarray], np.ndarray]:
        table = merged([np.concatenate(c) for c in zip(*(t[0] for t in self.tables))], np.concatenate([t[1] for t in self.tables]))
        self.tables, self.rows = [table], len(table[1])
        self.merged = self.rows
        return table


def _read_off(subtree: Subtree, lang: str, partition: Partition, min_count: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, n) of the nodes that are frequent, or of which other groups hold a part."""
    columns, counts = subtree.merge()
    words = [b"", *subtree.numbers]
    seed = xxhash.xxh64_intdigest(lang, seed=SEED)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed=seed) for w in words), np.uint64, len(words)) if len(partition.hot) > 1 else None
    for path, sums in nodes(columns, counts):
        kept = sums >= min_count
        if len(path) <= len(partition.hot):  # prefixes of this length may have been extended
            hash_of = hashes[path[0]]
            for column in path[1:]:
                hash_of = mixed(hash_of, hashes[column])
            kept |= partition.is_hot(len(path), hash_of)
        path, sums = [c[kept].tolist() for c in path], sums[kept]
        phrases = [b" ".join([words[i] for i in numbers]) for numbers in zip(*path)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(sums), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(sums), len(path), np.int32)), pa.array(sums)],
            names=["lang", "phrase", "words", "n"])


def _subtrees(leaves: DataFrame, partition: Partition, min_count: int) -> DataFrame:
    shared = leaves.sparkSession.sparkContext.broadcast(partition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, subtree = None, Subtree()
        for batch in slices(batches, 64):
            for group, lang, raw in zip(*(column.to_pylist() for column in batch.columns)):
                if before not in (None, (group, lang)):
                    yield from _read_off(subtree, before[1], shared.value, min_count)
                    subtree = Subtree()
                before = group, lang
                subtree.add(raw)
        if before:
            yield from _read_off(subtree, before[1], shared.value, min_count)

    dealt = leaves.repartition("group").sortWithinPartitions("group", "lang")
    return dealt.mapInArrow(run, "lang string, phrase string, words int, n long")


def phrase_counts(documents: DataFrame, max_words: int = 3, min_count: int = 10, text_col: str = "text", lang_col: str = "lang", budget: int = BUDGET, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Words with their counts, and the phrases of 2 to ``max_words`` words with theirs: ``(lang, word, n)`` as of :func:`word_counts`, ``(lang, phrase, words, n)``."""
    texts = documents.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    words = word_counts(texts, min_count, size)
    partition = partition_prefixes(texts, words, max_words, budget, size)
    found = _subtrees(_leaves(texts, partition, max_words, size), partition, min_count)
    if len(partition.hot) > 1:  # phrases that were extended are in several groups
        found = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return words, written(found, "phrases")


def collocations(
    documents: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000, covered: int = 50, text_col: str = "text", lang_col: str = "lang", budget: int = BUDGET, size: int = CHUNK, spread: int = 64,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, its count ``a``, the counts ``l`` and ``r`` of the two parts of its weakest cut, ``n`` words of the language, ``score``.

    The score of a cut is ``floor(1000000 * a * a / (l * r))``; the lowest one counts, the earliest of equal ones. A phrase that lies in a longer one with at
    least ``covered`` per cent of its occurrences is dropped. Counts below 10^15 keep all products within 38 digits. Ranking takes the best of ``spread``
    parts of a language, then of an eighth as many, before the best of all, so that no task sorts a whole language.
    """
    words, phrases = phrase_counts(documents, max_words, min_count, text_col, lang_col, budget, size)
    part = lambda start, length: F.array_join(F.slice("said", start, length), " ")
    said = phrases.withColumn("said", F.split("phrase", " "))
    cuts = said.select("lang", "phrase", F.col("n").alias("a"), "said", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("first"), part(F.lit(1), F.col("k")).alias("side")),
        F.struct(F.lit(False).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("side")))).alias("s")).select("lang", "phrase", "a", "k", "s.first", "s.side")
    counts = words.where("word IS NOT NULL").select("lang", F.col("word").alias("side"), F.col("n").alias("m"))
    counts = counts.unionByName(phrases.where(F.col("words") < max_words).select("lang", F.col("phrase").alias("side"), F.col("n").alias("m")))
    known = sides.join(counts, ["lang", "side"])
    inside = said.where("words > 2").select("lang", "n", "words", "said", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("length"))
    inside = inside.select("lang", "n", "length", "said", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)).alias("start"))
    longer = inside.select("lang", part(F.col("start"), F.col("length")).alias("phrase"), F.col("n").alias("longer"))
    gathered = known.select("lang", "phrase", "a", F.struct("k", "first", "m").alias("side"), F.lit(None).cast("long").alias("longer")).unionByName(
        longer.select("lang", "phrase", F.lit(None).cast("long").alias("a"), F.lit(None).cast("struct<k:int,first:boolean,m:bigint>").alias("side"), "longer"))
    per_cut = [
        F.struct(
            F.max(F.when((F.col("side.k") == k) & F.col("side.first"), F.col("side.m"))).alias("l"), F.max(F.when((F.col("side.k") == k) & ~F.col("side.first"), F.col("side.m"))).alias("r")).alias(f"cut{k}")
        for k in range(1, max_words)]
    whole = gathered.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *per_cut).where("a IS NOT NULL AND (longer IS NULL OR 100 * longer < %d * a)" % covered)
    score = lambda k: F.expr(
        f"(1000000 * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(cut{k}.l AS DECIMAL(15,0)) * CAST(cut{k}.r AS DECIMAL(15,0)))")
    weakest = F.array_min(F.filter(F.array(*[F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"cut{k}.l").alias("l"), F.col(f"cut{k}.r").alias("r")) for k in range(1, max_words)]), lambda c: c.score.isNotNull()))
    scored = whole.withColumn("cut", weakest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = scored
    for parts in (spread, spread // 8):
        best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(max(1, parts))))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.where("word IS NULL").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
