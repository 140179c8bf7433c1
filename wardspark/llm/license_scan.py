"""License detection by ordered signature rules, with Spark functions only.

Method: a document's words form one line; a keyword prefilter decides per rule whether it can match; at every place where
a rule's first word stands, its expression is tried on the words that follow. At one place the rule of the highest rank,
then the longest match, then the earlier rule wins. Between places, interval containment decides: a detection inside
another one of at least its rank is suppressed, and so is one that holds a detection of higher rank.

All of it happens inside the row: no shuffle, and rows with equal or null ids stay apart. Null and empty texts have no
words, no labels and score 0. Other columns of the input are ignored.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wardspark.llm.license_rules import BASE, GRANT_WORDS, Rule, rules
from wardspark.llm.shared import let, word_array, word_line

#: Words a match can span; no expression of the rules matches more.
REACH = 32
#: Score of a document by the highest rank among what was found.
SCORES = {0: 0.0, 1: 0.4, 2: 0.7, 3: 0.8, 4: 0.95, 5: 1.0}


def _starts(found: list[Rule]) -> dict[tuple[str, ...], list[int]]:
    """The rules by the word that stands at a place; words that open a grant share one entry."""
    groups: dict[tuple[str, ...], list[int]] = {GRANT_WORDS: []}
    for number, rule in enumerate(found):
        for word in dict.fromkeys(GRANT_WORDS if start in GRANT_WORDS else (start,) for start in rule.starts):
            groups.setdefault(word, []).append(number)
    return groups


def _best_at(found: list[Rule], keywords: list[str]) -> str:
    """SQL for what wins at a place ``x`` (word, start, ahead): (rank, characters, -rule). One text, since hundreds of rules are slow to put together call by call."""

    def tried(number: int) -> str:
        rule = found[number]
        pattern = f"^(?:{rule.pattern})(?= |$)"
        won = f"named_struct('rank', {rule.rank}, 'size', length(regexp_extract(x.ahead, '{pattern}', 0)), 'order', {-number})"
        return f"CASE WHEN _present[{keywords.index(rule.keyword)}] AND x.ahead RLIKE '{pattern}' THEN {won} END"

    whens = []
    for words, numbers in _starts(found).items():
        named = ", ".join(f"'{w}'" for w in words)
        whens.append(f"WHEN x.word IN ({named}) THEN array_max(array({', '.join(map(tried, numbers))}))")
    return f"CASE {' '.join(whens)} END"


def _places(words: Column, phrase: str, label: str) -> Column:
    parts = phrase.split(" ")
    first = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    whole = F.filter(first, lambda i: reduce(lambda a, b: a & b, (F.coalesce(F.get(words, i + n) == part, F.lit(False)) for n, part in enumerate(parts) if n)))
    return F.transform(whole, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _standing(hits: Column) -> Column:
    """Detections, in order of their places, without those that lose to another one around or inside them."""

    def stands(hit: Column, i: Column) -> Column:
        before = F.slice(hits, F.greatest(i - REACH + 1, F.lit(1)), F.least(i, F.lit(REACH)))
        after = F.slice(hits, i + 2, REACH)
        inside = F.exists(before, lambda other: (other.end >= hit.end) & (other["rank"] >= hit["rank"]))
        beaten = F.exists(after, lambda other: (other.end <= hit.end) & (other["rank"] > hit["rank"]))
        return ~inside & ~beaten

    return F.filter(hits, stands)


def license_scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: list[Rule] | None = None) -> DataFrame:
    """Per document: its words, the places of the base phrases, and the detections that stand.

    Columns: the id, ``n_words``, ``base`` (start word, label), ``detections`` (start and end word, rank, label), in text order.
    """
    found = found or rules()
    keywords = list(dict.fromkeys(rule.keyword for rule in found))
    opening = sorted({word for rule in found for word in rule.starts})
    labels = F.lit([rule.label for rule in found])
    none = F.array().cast("array<string>")
    lines = documents.select(F.col(id_col).alias("_id"), word_line(F.col(text_col)).alias("_line"))
    gated = lines.select("_id", word_array(F.col("_line")).alias("_all"), F.array(*[F.contains("_line", F.lit(keyword)) for keyword in keywords]).alias("_present"))
    gated = gated.select("_id", "_present", F.size("_all").cast("long").alias("_n"), F.when(F.array_contains("_present", True), F.col("_all")).otherwise(none).alias("_words"))
    spots = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("word"), i.alias("start"))), lambda x: x.word.isin(*opening))
    ahead = F.transform(spots, lambda x: F.struct(x.word.alias("word"), x.start.alias("start"), F.array_join(F.slice("_words", x.start + 1, REACH), " ").alias("ahead")))
    base = F.array_sort(F.concat(*[_places(F.col("_words"), phrase, label) for phrase, label in BASE]))
    tried = gated.select("_id", "_n", base.alias("_base"), "_present", ahead.alias("_ahead")).select(
        "_id", "_n", "_base", F.expr(f"transform(_ahead, x -> named_struct('start', x.start, 'ahead', x.ahead, 'won', {_best_at(found, keywords)}))").alias("_tried"))
    hits = F.transform(F.filter("_tried", lambda x: x.won.isNotNull()), lambda x: F.struct(
        x.start.alias("start"), (x.start + F.size(F.split(F.substring(x.ahead, F.lit(1), x.won["size"]), " "))).alias("end"),
        x.won["rank"].alias("rank"), F.get(labels, -x.won["order"]).alias("label")))
    return tried.select(F.col("_id").alias(id_col), F.col("_n").alias("n_words"), F.col("_base").alias("base"), let(hits, _standing).alias("detections"))


def license_report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One line per document out of :func:`license_scan`: counts, labels and a score from 0 to 1."""
    base_labels, labels = F.transform("base", lambda x: x.label), F.transform("detections", lambda x: x.label)
    starts = F.transform("base", lambda x: x.start.cast("long"))
    rank = F.coalesce(F.array_max(F.transform("detections", lambda x: x["rank"])), F.when(F.size("base") > 0, 2), F.lit(0))
    return scanned.select(
        id_col, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, labels))), ",").alias("labels"),
        F.element_at(F.lit([SCORES[k] for k in sorted(SCORES)]), rank + 1).alias("score"),
        F.array_join(F.transform("detections", lambda x: F.concat_ws(":", x.label, x.start.cast("string"), x.end.cast("string"))), ",").alias("detections"),
    )
