"""How filters act together: counts over all orders of applying them, by paths through the lattice of subsets."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from instqc.llm.common import WORD, attach, bounded
from instqc.session import cut_lineage

#: Filters whose orders are listed one by one; beyond, ask for shares only.
MOST_LISTED = 6


def ways(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders) for every edge of the lattice of subsets of ``n`` filters.

    A state is the set of filters applied so far, as bits; an edge adds one.
    Going forward, the orders that reach a state are the sum over the edges
    into it; going backward, those that lead from it to the full set are the
    sum over the edges out of it. Their product is how many orders use the
    edge.
    """
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if state >> f & 1:
                leave[state ^ 1 << f] += leave[state]
    return [(s, f, reach[s] * leave[s | 1 << f]) for s in range(full + 1) for f in range(n) if not s >> f & 1]


def edges(failures: DataFrame, n: int, part: str = "part") -> DataFrame:
    """What each filter removes in each state: one row per part and edge, zeros included.

    ``failures`` has (part, mask, good, toxic): the bits of the filters that a
    document fails, and two flags. It is counted by these few values first,
    with sums per task before the shuffle, so a hot part costs nothing; only
    the counts meet the edges. A null part counts as the empty string.
    Columns: part, state, filter, orders, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost.
    """
    failures = failures.withColumn(part, F.coalesce(F.col(part).cast("string"), F.lit("")))
    counts = failures.groupBy(part, "mask", "good", "toxic").agg(F.count("*").alias("n"))
    listed = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("orders")) for s, f, w in ways(n)])
    met = counts.select("*", F.inline(listed))
    fails = F.expr("(mask & shiftleft(1, filter)) <> 0")
    gone = F.expr("(mask & state) <> 0")
    removed = fails & ~gone
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0))).cast("long")
    return met.groupBy(part, "state", "filter", "orders").agg(
        total(~fails & ~gone).alias("kept"), total(removed).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.expr("mask = shiftleft(1, filter)")).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"), total(removed & F.col("toxic")).alias("toxic_lost"),
    )


def shares(edge_table: DataFrame, part: str = "part") -> DataFrame:
    """(part, filter, shapley): documents a filter removes, summed over all orders; divided by their number, its Shapley value."""
    return edge_table.groupBy(part, "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))


def audit(failures: DataFrame, names: str, part: str = "part") -> DataFrame:
    """One row per part, order and step, read off the edges; see ``edges`` for the counts.

    ``names`` has one letter per filter, for bits 0, 1 and so on. Step i of an
    order is the edge from the set of its first i - 1 filters along its i-th,
    so nothing is counted again per order. The orders' steps are n * n! rows
    (600 for five filters), broadcast as a table of that fixed size.
    """
    n = len(names)
    if not 1 <= n <= MOST_LISTED or len(set(names)) != n:
        raise ValueError(f"name 1 to {MOST_LISTED} filters by different letters")
    table = cut_lineage(edges(failures, n, part))
    steps = []
    for order in permutations(range(n)):
        state = 0
        for i, f in enumerate(order, 1):
            steps.append(("".join(names[g] for g in order), i, state, f))
            state |= 1 << f
    listed = table.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    joined = table.join(F.broadcast(listed), ["state", "filter"]).join(shares(table, part), [part, "filter"])
    return joined.select(
        part, "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> list[tuple[str, Column]]:
    """Conditions under which a text fails, null counting as empty.

    A: under 100 words. B: fewer than 80 % of its words are distinct.
    C: more than 10 % of its code points are A-Z. D: it holds one of #$%&*|.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        ("A", F.size(words) < 100),
        ("B", 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)),
        ("C", 100 * capitals > 10 * F.length(text)),
        ("D", text.rlike(r"[#$%&*|]")),
    ]


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document: filters A to D of ``text_filters``, and E.

    E: the text is identical to that of a smaller doc_id anywhere in the
    table. Equal texts are found by their SHA-256, reduced per task to the
    least id before the shuffle; only digests with more than one row are
    joined back, salted unless few. Labels go by shuffle too unless few. A row without a doc_id has no smaller one
    and does not fail E; nor does it have labels. Where ``labels`` has an id
    more than once, one row with quality 1 (toxic 1) is enough. Rows that
    repeat a doc_id count apart. The part is ``lang``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(test, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, test) in enumerate(text_filters(F.col("text")))]
    mask = bits[0] + bits[1] + bits[2] + bits[3]
    rows = cut_lineage(docs.select("doc_id", F.col("lang").cast("string").alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask")))
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = attach(rows, groups, ["digest"], ["doc_id"], "left")
    flags = labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("first") < F.col("doc_id"), F.lit(16)).otherwise(F.lit(0))).join(bounded(cut_lineage(flags)), "doc_id", "left")
    return rows.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
