"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from instqc.llm.common import BROADCAST_ROWS, attach, carried, digest, words_of
from instqc.session import cut_lineage

#: Words of the stretch that must agree, and how many of them.
STRETCH, AGREE = 16, 13
#: Positions that a seed reads. Whichever 3 words of a stretch of 16 are
#: replaced, one of the two fits between them at some place.
MASKS = ("101100111", "11100001011")
#: Items with fewer words than a stretch, from so many on, may have so many words replaced. Of the words that agree,
#: at least four then stand in a row: 8 words with one replaced leave 7 in two rows, 12 with two replaced 10 in three.
TOLERANT = {8: 1, 12: 2}
SHORT_MASK = "1111"
#: Items with fewer words are met by chance: they are reported where they stand whole, but no document goes for them.
LEAST_WORDS = 8


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))


def needed(n: Column) -> Column:
    """How many words of an item of ``n``, or of a stretch of a long one, must agree."""
    out = n
    for least, replaced in sorted(TOLERANT.items()):
        out = F.when(n >= least, n - replaced).otherwise(out)
    return F.when(n >= STRETCH, F.lit(AGREE)).otherwise(out)


def seeds(hashes: str, masks: tuple[str, ...]) -> Column:
    """The hashes that each mask reads at each position, mask after mask; the mask is part of the hash."""
    def of(mask: str) -> Column:
        read = [i for i, bit in enumerate(mask) if bit == "1"]
        last = F.size(hashes) - len(mask)
        at = lambda i: F.xxhash64(F.lit(mask), *(F.get(hashes, i + k) for k in read))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*map(of, masks))


def seed_rows(df: DataFrame, key: str, masks: tuple[str, ...], name: str) -> DataFrame:
    """One row per seed: key, _seed, and its place in words as ``name``."""
    hashed = df.select(key, word_hashes(F.col("text")).alias("_h")).select(key, "_h", F.size("_h").alias("_w")).select(key, "_w", seeds("_h", masks).alias("_s"))
    # The outer form: for the other, Spark infers a filter that would compute all seeds word by word again.
    rows = hashed.select(key, "_w", F.posexplode_outer("_s").alias("_p", "_seed")).filter("_seed IS NOT NULL")
    place, start = F.col("_p"), F.lit(0)
    for mask in masks:
        place = F.when(F.col("_p") >= start, F.col("_p") - start).otherwise(place)
        start = start + F.greatest(F.col("_w") - (len(mask) - 1), F.lit(0))
    return rows.select(key, "_seed", place.alias(name))


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(_th, item_id, diagonal): where a seed of a text meets one of an item, once each.

    ``docs`` has _th, a digest of the text, so copies of a text count once.
    Items of STRETCH words and more are sought by MASKS, from LEAST_WORDS on
    by SHORT_MASK, and shorter ones whole, by a mask of their own length. The
    benchmark's seeds are counted and broadcast if few; the corpus's seeds
    are then never shuffled. Else both are dealt by seed.
    """
    size = F.size("words")
    few = {r["n"] for r in items.filter(size < LEAST_WORDS).select(size.alias("n")).distinct().collect()}
    kinds = [(size >= STRETCH, MASKS), ((size >= LEAST_WORDS) & (size < STRETCH), (SHORT_MASK,)), *((size == n, ("1" * n,)) for n in sorted(few))]
    kinds = [(test, sought) for test, sought in kinds if items.filter(test).take(1)]
    if not kinds:
        return docs.sparkSession.createDataFrame([], docs.select("_th").schema.add("item_id", items.schema["item_id"].dataType).add("diagonal", "integer"))
    masks = tuple(dict.fromkeys(m for _, sought in kinds for m in sought))
    wanted = cut_lineage(reduce(DataFrame.unionByName, (seed_rows(items.filter(test), "item_id", sought, "_at") for test, sought in kinds)))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = seed_rows(docs, "_th", masks, "_place").join(wanted, "_seed")
    return found.select("_th", "item_id", (F.col("_place") - F.col("_at")).alias("diagonal")).distinct()


def overlaps(texts: DataFrame, found: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates verified word by word along their diagonal; the columns of ``texts`` with item_id, first_word, agreeing, item_words."""
    rows = attach(texts, found, ["_th"], ["text"])
    rows = attach(rows, items.select("item_id", F.col("words").alias("_b")), ["item_id"], ["_th"])
    there = F.slice(words_of(F.lower("text")), F.greatest("diagonal", F.lit(0)) + 1, F.size("_b"))
    # Written, so that each text is cut into words once per candidate and not once per word compared.
    rows = cut_lineage(rows.withColumn("_a", there).drop("text"))
    # 1 where the word of the text equals that of the item.
    same = F.transform("_b", lambda b, j: F.coalesce((F.get("_a", j + F.least("diagonal", F.lit(0))) == b).cast("int"), F.lit(0)))
    rows = rows.withColumns({"_same": same, "_n": F.size("_b")}).drop("_a")
    stretch = F.least("_n", F.lit(STRETCH))
    need = needed(F.col("_n"))
    total = lambda array: F.aggregate(array, F.lit(0), lambda a, x: a + x)
    windows = F.transform(F.sequence(F.lit(0), F.col("_n") - stretch), lambda i: total(F.slice("_same", i + 1, stretch)))
    return (
        rows.filter(F.array_max(windows) >= need)
        .withColumn("agreeing", total(F.col("_same")).cast("long"))
        .withColumns({"first_word": F.greatest("diagonal", F.lit(0)).cast("long"), "item_words": F.col("_n").cast("long")})
        .drop("_b", "_same", "_n", "diagonal")
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, agreeing, item_words) of every document and item that overlap.

    Words are runs of anything but ASCII white space, lower-cased. Document
    and item overlap if 13 of 16 words in a row agree place by place; of an
    item of 12 to 15 words all but two must be there, of one of 8 to 11 all
    but one, and shorter ones must be there whole (item_words tells which they
    are, as such a few words also meet by chance). Every such overlap is
    found: the masks hit between any words replaced, see MASKS and TOLERANT.
    Items without words meet nothing. first_word is where the item starts in the document (0 if cut
    off) at the place with most agreeing words. Documents without overlap,
    null and empty texts give no rows; repeated rows give one.
    """
    keyed = docs.select("doc_id", "text").filter("text IS NOT NULL").withColumn("_th", digest(F.col("text")))
    rows = _verified(keyed, benchmark)
    best = F.max(F.struct("agreeing", (-F.col("first_word")).alias("_back"), "item_words")).alias("_best")
    return rows.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("_best._back")).alias("first_word"), "_best.agreeing", "_best.item_words"
    )


def _verified(keyed: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps of ``keyed`` (text, _th and what else is to be returned)."""
    items = benchmark.filter("text IS NOT NULL").select("item_id", "text").withColumn("words", words_of(F.lower("text")))
    items = cut_lineage(items.filter(F.size("words") > 0).dropDuplicates(["item_id", "words"]))
    found = cut_lineage(candidates(keyed.select("_th", "text"), items))
    return overlaps(keyed, found, items)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item of LEAST_WORDS words or more, columns as given, whatever their names; null texts stay."""
    texts = docs.filter("text IS NOT NULL").select("text", digest(F.col("text")).alias("_th"))
    long = benchmark.filter(F.size(words_of(F.col("text"))) >= LEAST_WORDS)
    bad = cut_lineage(_verified(texts, long).select("_th").distinct())
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    keyed = docs.select(carried(docs), F.when(F.col("text").isNotNull(), digest(F.col("text"))).alias("_th"))
    return keyed.join(bad, "_th", "left_anti").select("_row.*")
