"""Scanning artifacts that come in chunks, with the results of the uncut text.

A chunk holds whole ``\\n`` lines. Line rules look at chunks one by one, however many there are of an artifact; running sums of lines over the chunks of an artifact give the
places, and the lines next to a chunk come along for the snippets. Rules over whole texts, the parser and manifests need the text in one piece: it is put
together only for artifacts in which such a rule can match, which the masks of the chunks tell beforehand. Only those texts have to fit into one value (2 GB).
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardspark.catalog import patterns as cat
from wardspark.catalog.rules import UNSAFE_WEIGHT_FORMATS
from wardspark.functions.anchors import any_bit, has_bit, in_own_words, text_facts
from wardspark.functions.slices import small_batches
from wardspark.functions.text import basename, numbered_lines, split_lines, suffix
from wardspark.operators import line_rules, scan, supply, text_rules
from wardspark.operators.code_rules import is_python
from wardspark.operators.hits import HITS, join_arrays
from wardspark.plans.storage import written

#: Detectors that look at lines, each for itself.
LINE_DETECTORS = ["secrets", "owasp"]
_AROUND = 2


def cut_artifacts(artifacts: DataFrame, lines: int) -> DataFrame:
    """Artifacts cut into chunks of so many lines: ``path, target, part, content``. A text without lines is one chunk."""
    pieces = F.split("content", "(?<=\n)", -1)  # every line keeps its end
    count = F.greatest(F.lit(1), F.ceil(F.size(pieces) / lines).cast("int"))
    chunks = F.when(F.col("content").isNull(), F.array(F.col("content"))).otherwise(
        F.get(F.transform(F.array(pieces), lambda p: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(p, i * lines + 1, F.lit(lines)), ""))), 0))
    return artifacts.select("path", "target", F.posexplode(chunks).alias("part", "content"))


def chunk_offsets(chunks: DataFrame) -> DataFrame:
    """Adds ``first_line`` and ``first_offset``: the lines and characters of the artifact before each chunk.

    A match at ``line`` and ``offset`` of a chunk stands at their sums in the artifact; columns are the same, as chunks begin with a line.
    """
    sized = chunks.withColumn("_lines", F.size(F.split(F.coalesce("content", F.lit("")), "\n", -1)) - 1).withColumn("_chars", F.coalesce(F.length("content"), F.lit(0)))
    before = Window.partitionBy("target", "path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda name: F.coalesce(F.sum(name).over(before), F.lit(0))
    return sized.withColumn("first_line", total("_lines").cast("int")).withColumn("first_offset", total("_chars")).drop("_lines", "_chars")


def _line_hits(secret_rules: list[dict], wanted: list[str]) -> list[Column]:
    lines, mask = F.col("_lines"), F.col("_mask")
    hits = []
    if "secrets" in wanted:
        hits.append(line_rules.line_pattern_hits(lines, mask, secret_rules + line_rules.builtin_rules(scan._FIRST["lines"])))
    if "owasp" in wanted:
        hits.append(line_rules.line_check_hits(lines, mask, scan._FIRST["checks"]))
    return hits


def _needs_whole(mask: Column, path: Column, wanted: list[str], rules: list[dict], custom_rules: list[dict], extra: bool) -> Column:
    """Whether a detector other than those of lines may find something: by what the masks of all chunks together say, or by name."""
    conditions = [F.lit(extra)]
    for part, detector in (("rag", "rag"), ("ssl", "rag"), ("agent", "agent"), ("code", "ast")):
        if detector in wanted:
            conditions += [has_bit(mask, scan._FIRST[part] + i) for i in range(len(scan._PARTS[part]))]
    if "ast" in wanted:
        conditions.append(is_python(path) & F.col("_odd"))
    if "supply" in wanted:
        conditions.append(supply.manifest_kind(path).isNotNull())
    if "model" in wanted:
        ext = F.replace(F.lower(suffix(path)), F.lit("."), F.lit(""))
        conditions += [ext.isin(*UNSAFE_WEIGHT_FORMATS), F.lower(basename(path)) == "config.json"]
    conditions += [text_rules.possible(mask, r) for r in rules] + [text_rules.wanted_here(path, mask, r) for r in custom_rules]
    return F.array_max(F.array(*conditions))


def _edge_lines(text: Column) -> tuple[Column, Column]:
    """The first and the last two lines of a text, without splitting all of it."""
    first = split_lines(F.substring_index(text, "\n", _AROUND + 1))
    last = split_lines(F.substring_index(text, "\n", -_AROUND - 2))
    return F.slice(first, 1, _AROUND), F.when(F.size(last) > _AROUND, F.slice(last, -_AROUND, _AROUND)).otherwise(last)


def _with_surroundings(hit: Column) -> Column:
    """A hit with the lines of its chunk that its snippet can show, and the number of the first of them."""
    first = F.greatest(F.lit(1), hit["line"] - _AROUND)
    return F.struct(hit.alias("hit"), first.alias("first"), F.slice("_lines", first, hit["line"] + _AROUND - first + 1).alias("shown"))


def _placed(x: Column) -> Column:
    """A hit at its place in the artifact, with its snippet: lines of the chunks above and below fill up what its own chunk lacks."""
    line = x["hit"]["line"]
    above = F.slice("above", F.greatest(F.lit(1), F.size("above") - (_AROUND - line)), F.greatest(F.lit(0), F.least(F.size("above"), F.lit(_AROUND + 1) - line)))
    below = F.slice("below", 1, F.greatest(F.lit(0), line + _AROUND - F.col("n_lines")))
    shown, at = F.concat(above, x["shown"], below), line + F.col("lines_before")
    start = x["first"] + F.col("lines_before") - F.size(above)
    seq = F.concat(F.array(at), F.slice(x["hit"]["seq"], 2, 2))
    return x["hit"].withField("line", at).withField("seq", seq).withField("snippet", F.coalesce(x["hit"]["snippet"], numbered_lines(shown, start, at)))


def scan_chunks(
    chunks: DataFrame, custom_rules: list[dict] | None = None, detectors: list[str] | None = None, extra_detectors: list | None = None, signature_rules: list[dict] | None = None,
    secret_rules: list[dict] | None = None,
) -> DataFrame:
    """``path, target, n_lines, hits`` of artifacts in chunks ``path, target, part, content``: what ``scan_artifacts`` gives for the uncut texts.

    Chunks other than the last of an artifact end with ``\\n``; their order is that of ``part``. The hits of lines are stored in the shared folder, for they are read twice.
    """
    wanted = detectors or cat.DETECTORS
    groups = in_own_words(scan.GROUPS)
    secrets = scan.gated(secret_rules if "secrets" in wanted else None, groups)
    signatures = scan.gated(signature_rules if "rag" in wanted else None, groups)
    custom = scan.gated(custom_rules if "custom" in wanted else None, groups)
    text = F.col("content")
    small_batches(chunks.sparkSession)
    looked = chunks.select("path", "target", "part", "content", text_facts(text, groups).alias("_facts"))
    looked = looked.select("path", "target", "part", "content", F.col("_facts.mask").alias("_mask"), F.col("_facts.n_lines").alias("n_lines"))
    needs_lines = any_bit(F.col("_mask"), len(scan.GROUPS))
    for rule in secrets:
        needs_lines |= text_rules.possible(F.col("_mask"), rule)
    staged = looked.withColumn("_lines", F.when(needs_lines, split_lines(text)).otherwise(F.array().cast("array<string>")))
    line_hits = [h.cast(HITS) for h in _line_hits(secrets, wanted)]
    staged = staged.withColumn("_hits", join_arrays(line_hits) if line_hits else F.array().cast(HITS))
    head, tail = _edge_lines(F.coalesce(text, F.lit("")))
    narrow = staged.select(
        "path", "target", "part", "_mask", "n_lines", F.coalesce(text.rlike("[^\\x00-\\x7f]"), F.lit(False)).alias("odd"), F.transform("_hits", _with_surroundings).alias("hits"), head.alias("head"), tail.alias("tail"))
    chunk_order = Window.partitionBy("target", "path").orderBy("part")
    earlier = F.flatten(F.collect_list("tail").over(chunk_order.rowsBetween(-_AROUND, -1)))
    placed = narrow.withColumns({
        "lines_before": F.coalesce(F.sum("n_lines").over(chunk_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"), "earlier": earlier,
        "below": F.flatten(F.collect_list("head").over(chunk_order.rowsBetween(1, _AROUND)))})
    placed = placed.withColumn("above", F.when(F.size("earlier") > _AROUND, F.slice("earlier", -_AROUND, _AROUND)).otherwise(F.col("earlier")))
    masks = [F.bit_or(F.get("_mask", i)).alias(f"m{i}") for i in range(-(-len(groups) // 63))]
    lined = placed.select("path", "target", "_mask", "odd", "n_lines", F.transform("hits", _placed).alias("hits")).groupBy("target", "path").agg(
        F.sum("n_lines").cast("int").alias("n_lines"), F.flatten(F.collect_list("hits")).alias("hits"), F.max("odd").alias("_odd"), *masks)
    lined = lined.withColumn("_mask", F.array(*[f"m{i}" for i in range(len(masks))]))
    rest = [d for d in wanted if d not in LINE_DETECTORS]
    lined = lined.select("path", "target", "n_lines", "hits", _needs_whole(F.col("_mask"), F.col("path"), rest, signatures, custom, bool(extra_detectors)).alias("whole"))
    if not rest and not extra_detectors:
        return lined.drop("whole")
    lined = written(lined, "lined")
    in_need = lined.where("whole").select("path", "target")
    pieces = chunks.select("path", "target", "part", "content").join(in_need, ["path", "target"], "left_semi").groupBy("path", "target").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("c"))
    joined = F.when(F.exists("c", lambda c: c["content"].isNotNull()), F.array_join(F.transform("c", lambda c: c["content"]), ""))
    texts = scan.scan_artifacts(pieces.select("path", "target", joined.alias("content")), custom_rules, rest, extra_detectors, signature_rules)
    texts = texts.select("path", "target", F.col("hits").alias("more")).hint("merge")  # of unknown size: chunks out of Python count for a few bytes
    both = lined.select("path", "target", "n_lines", "hits").join(texts, ["path", "target"], "left")
    return both.select("path", "target", "n_lines", F.concat("hits", F.coalesce("more", F.array().cast(HITS))).alias("hits"))
