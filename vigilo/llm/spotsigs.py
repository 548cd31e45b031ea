"""Document fingerprints from spot signatures, in DataFrame expressions only.

A signature is a chain: a common word (the anchor) and the next content words after it, other common words skipped.
Where words run on without a common one each is an anchor, and a text too short for any chain gives its words.
A fingerprint is the sorted set of hashed signatures; likeness is
the Jaccard similarity of two sets.  ``near_pairs`` searches a table: sets are partitioned by length, and only sets
whose lengths allow the threshold and that share one of their rarest signatures are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilo.llm.common import materialize, shuffle_partitions, text_or_empty

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he in is it not of on or that the this to was were which with "
    "au aux ce dans de des du elle en est et il la le les par pas pour qui que se sur un une "
    "als auch auf das dem den der des die ein eine er es für im ist mit nicht sich sie und von wie zu zum "
    "al con del el ella las lo los más no para por su una y"
).split()
#: Content words of a chain.
CHAIN = 2
#: Common words in a row that a chain skips; one more counts as content.
SKIP = 8
#: Words in a row without a common one from which on each is an anchor, so that lists and word salad have chains too.
DRY = 6


def _any_of(words: list[str]) -> str:
    """A pattern for the words that shares their beginnings, so that a word is left after a letter or two."""

    def build(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in rest:
            if w:
                heads.setdefault(w[0], []).append(w[1:])
        branches = [h + build(t) for h, t in sorted(heads.items())]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in rest else f"(?:{'|'.join(branches)})"
        return f"{body}?" if "" in rest else body

    return build(sorted(set(words)))


def signatures(text: Column) -> Column:
    """Sorted distinct 31-bit hashes of the text's signatures; none for a text without letters or digits."""
    common = _any_of(ANCHORS)
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    link = rf"(?:{common} ){{0,{SKIP}}}+[^ ]+ "
    content = rf"(?!{common} )[^ ]+ "
    chain = rf"(?<= )(?=({common} {link * CHAIN}|(?:{content}){{{CHAIN + 1}}}(?=(?:{content}){{{DRY - CHAIN - 1}}})))"
    none = F.array().cast("array<string>")

    def chains(w: Column) -> Column:
        found = F.regexp_extract_all(w, F.lit(chain), F.lit(1))
        # Common words inside a chain go; the anchor, at its start, and the last content word stay.
        tidy = lambda f: F.split(F.regexp_replace(F.concat_ws("|", f), rf"(?<= ){common} (?!\||$)", ""), r"\|")
        every = lambda: F.regexp_extract_all(w, F.lit(rf"(?<= )(?=((?:[^ ]+ ){{{CHAIN + 1}}}))"), F.lit(1))
        few = lambda: F.when(F.size(every()) > 0, every()).when(F.length(w) > 2, F.array(w)).otherwise(none)
        return F.flatten(F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, tidy(f)).otherwise(few())))

    # One-element arrays bind the words and the chains, so that each is made once.
    used = F.flatten(F.transform(F.array(words), chains))
    return F.sort_array(F.array_distinct(F.transform(used, lambda s: F.xxhash64(s).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity; two empty sets are alike, an empty and another are not."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1)))


def as_text(sigs: Column) -> Column:
    return F.concat_ws(" ", sigs.cast("array<string>"))


def _ranges(docs: DataFrame, n: int) -> tuple[list[int], list[int], list[int]]:
    """Ascending bounds of at most ``n`` ranges of doc_id with like numbers of rows; of each range that has rows, its first id and the range before it (of the first: the last)."""
    ids = docs.select(F.col("key").cast("double").alias("d"))
    cuts = sorted({int(x) for x in ids.stat.approxQuantile("d", [k / n for k in range(1, n)], 1 / (4 * n))} if n > 1 else set())
    size = 1
    while size <= len(cuts):
        size *= 2
    bounds = cuts + [(1 << 63) - 1] * (size - 1 - len(cuts))
    held = sorted((r[0], r[1]) for r in docs.select(_range_of(F.col("key"), bounds).alias("r"), "key").groupBy("r").agg(F.min("key")).collect())
    first, before = [0] * size, [-1] * size
    for k, (r, least) in enumerate(held):
        first[r], before[r] = least, held[k - 1][0]
    return bounds, first, before


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the key, by binary search; there are 2^k - 1 bounds."""
    if not bounds:
        return F.lit(0)
    held = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    steps, s = [], (len(bounds) + 1) // 2
    while s:
        steps.append(s)
        s //= 2
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.element_at(held, at + step) <= key, at + step).otherwise(at))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, ``columns``, next_*): each row with those of the next in ascending doc_id order, the last with the first.

    Rows are dealt to ranges of ids; the first row of each range is also sent to the range before it, so no row needs
    to meet all others.  Null ids come first; rows with one id follow each other by the hash of their text.
    """
    low = -(1 << 63)
    keyed = docs.withColumn("key", F.coalesce(F.col("doc_id"), F.lit(low)))
    bounds, first, before = _ranges(keyed, 2 * shuffle_partitions(docs.sparkSession))
    placed = keyed.withColumn("r", _range_of(F.col("key"), bounds))
    at = F.col("r") + 1
    is_first = F.col("key") == F.element_at(F.array(*map(F.lit, first)).cast("array<bigint>"), at)
    home = F.struct(F.col("r").alias("r"), F.lit(0).alias("ghost"))
    away = F.struct(F.element_at(F.array(*map(F.lit, before)), at).alias("r"), F.lit(1).alias("ghost"))
    sent = placed.select("doc_id", "key", *columns, F.explode(F.when(is_first, F.array(home, away)).otherwise(F.array(home))).alias("to"))
    w = Window.partitionBy("range").orderBy("ghost", "key", "tie")
    flat = sent.select("doc_id", "key", *columns, F.col("to.r").alias("range"), F.col("to.ghost").alias("ghost"), F.xxhash64("text").alias("tie"))
    return flat.select("doc_id", "ghost", *columns, *(F.lead(c).over(w).alias(f"next_{c}") for c in columns)).where("ghost = 0").drop("ghost")


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """For every row its fingerprint and that of its edited text, and how alike they and the next row's are.

    The edited text ends, for its last quarter, with the beginning of the next document.  Null text counts as empty;
    an empty table gives an empty result; other columns are ignored.
    """
    sigs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("sigs", signatures(F.col("text")))
    pairs = with_next(sigs, ["text", "sigs"]).withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.substring("next_text", F.lit(1), tail)))
    both = edited.withColumn("edited_sigs", signatures(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sigs")).alias("fingerprint"),
        as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, likeness) of signature sets at or above the threshold, and (doc_id, class_id).

    Rows with equal sets are one class, named by its smallest doc_id; pairs are between classes.  A set's signatures
    are ordered from the rarest on; two sets alike enough share one of their first |set| - ceil(threshold * |set|) + 1.
    Classes are also split by length: a length only meets lengths within the threshold.
    """
    sigs = docs.select("doc_id", signatures(text_or_empty()).alias("sigs"))
    members = materialize(sigs, "spots").withColumn("class_id", F.min("doc_id").over(Window.partitionBy("sigs")))
    classes = members.where("doc_id = class_id and size(sigs) > 0").select("class_id", "sigs").dropDuplicates(["class_id"])
    counts = classes.select(F.explode("sigs").alias("s")).groupBy("s").agg(F.count("*").alias("c"))
    ranked = classes.select("class_id", F.explode("sigs").alias("s")).join(counts, "s").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("o"))
    n = F.size("o")
    head = ranked.select("class_id", n.alias("n"), F.explode(F.slice("o", 1, (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))).alias("h")).select("class_id", "n", F.col("h.s").alias("s"))
    # Lengths in bands whose ends are the threshold apart: a set meets those of its band and the next.
    band = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold)) if threshold < 1 else F.col("n")).cast("int")
    left = head.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "s", band.alias("band"))
    right = head.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "s", F.explode(F.array(band, band - 1)).alias("band"))
    met = left.join(right, ["s", "band"]).where((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("a") < F.col("b")))).where(F.col("na") >= threshold * F.col("nb"))
    met = met.select("a", "b").distinct()
    full = classes.select("class_id", "sigs")
    checked = met.join(full.select(F.col("class_id").alias("a"), F.col("sigs").alias("sa")), "a").join(full.select(F.col("class_id").alias("b"), F.col("sigs").alias("sb")), "b")
    pairs = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return pairs.where(F.col("likeness") >= threshold), members.select("doc_id", "class_id")
