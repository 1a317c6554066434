"""Line deduplication with an edit join over segments."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from instqc.llm.common import bounded, only_keys
from instqc.session import cut_lineage

#: Edits between near-equal lines.
EDITS = 2
#: Shorter lines are only compared whole: two edits would turn one into another.
LEAST_CHARS = 24
#: Letters counted in every line, four bits each.
LETTERS = "etaonihr"
#: Pieces of a line of which all but ``edits`` must stand in a near-equal one.
PIECES = 8
#: Lines under one key beyond which they do not meet there but by finer keys.
CROWD = 32
#: Segments of the lines of crowds, step by step; at the last all meet.
FINER = (6, 12, 24)


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, pos, line, id): the lines of each text that are not blank."""
    keyed = docs.select("doc_id", "text").withColumn("_th", F.xxhash64(F.coalesce("text", F.lit("")))).filter("text IS NOT NULL")
    rows = keyed.select("doc_id", "_th", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    return rows.filter(F.trim("line") != "").withColumn("id", F.xxhash64("line"))


def segments(length: Column, parts: int) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of the segments of a line, the longer ones last."""
    short = F.floor(length / parts).cast("int")
    first_long = parts - length % parts
    return [(short * i + F.greatest(F.lit(i) - first_long, F.lit(0)).cast("int"), (short + F.when(F.lit(i) >= first_long, 1).otherwise(0)).cast("int")) for i in range(parts)]


def segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` (line, size) with what each puts into the index as ``key``: a hash of line length, segment number and segment."""
    return _keys(lines, [(0, i, 0) for i in range(edits + 1)], edits)


def probe_keys(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` (line, size) with the index keys of all lines, not longer, that may be within ``edits`` of each, as ``key``.

    For a line shorter by ``gap``, segment i can only have moved so far that
    the edits before it and those after it both fit: from its own start by up
    to i, and from its start plus gap by up to edits - i, either way.
    """
    shapes = [
        (gap, i, move) for gap in range(edits + 1) for i in range(edits + 1)
        for move in range(max(-i, gap - (edits - i)), min(i, gap + edits - i) + 1)
    ]
    return _keys(lines, shapes, edits)


def _keys(lines: DataFrame, shapes: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """A row per line and shape (gap, segment, move): a line meets constants, and one short expression makes the key of each."""
    held = F.expr("array({})".format(", ".join(f"named_struct('_gap', {gap}, '_i', {i}, '_move', {move})" for gap, i, move in shapes)))
    parts = edits + 1
    rows = lines.select("*", F.inline(held)).withColumn("_size", F.expr("size - _gap")).withColumns({
        "_short": F.expr(f"CAST(floor(_size / {parts}) AS INT)"), "_long": F.expr(f"{parts} - _size % {parts}")})
    rows = rows.withColumns({
        "_start": F.expr("_short * _i + greatest(_i - _long, 0) + _move"), "_length": F.expr("_short + IF(_i >= _long, 1, 0)")})
    rows = rows.filter("_start >= 0 AND _start + _length <= size")
    return rows.select(*lines.columns, F.expr("xxhash64(_size, _i, substring(line, _start + 1, _length)) AS key"))


def letter_counts(line: Column) -> Column:
    """How often each of LETTERS stands in a line, modulo 16, four bits each."""
    count = lambda c: F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
    return reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(count(c).bitwiseAND(F.lit(15)), 4 * i) for i, c in enumerate(LETTERS)))


def letters_apart(one: str, two: str) -> Column:
    """By how many the letter counts of two lines differ at least; an edit changes two counts by one at most."""
    digit = lambda c, i: F.shiftright(c, 4 * i).bitwiseAND(F.lit(15))
    off = lambda i: F.abs(digit(one, i) - digit(two, i))
    return reduce(lambda x, y: x + y, (F.least(off(i), 16 - off(i)) for i in range(len(LETTERS))))


def finer_keys(lines: DataFrame, parts: int, edits: int, probing: bool) -> DataFrame:
    """``lines`` (line, size) with keys that hold all of a line but ``edits`` of ``parts`` segments, as ``key``, and of each of those a hash as ``_z0``... and letter counts as ``_l0``...

    Edits of near-equal lines lie in ``edits`` segments of the shorter one at
    most; what lies between has moved as one, by a shift that changes only
    there and by all edits at most. Probes try each choice and its shifts,
    for lines shorter by up to ``edits``. A segment of a probe that need not
    be left out (it has not moved against its neighbour) has a hash only if
    a segment before it is kept: lines whose hashes there are equal meet by
    another choice too, the one that leaves out the first segments. ``_even``
    tells probes for lines of the same length.
    """
    zones = range(edits)
    shifts = [(0, *s, gap) for gap in range(edits + 1 if probing else 1) for s in product(range(-edits, edits + 1) if probing else (0,), repeat=edits - 1)]
    shifts = [s for s in shifts if sum(abs(x - y) for x, y in zip(s, s[1:], strict=False)) <= edits]
    table = lambda name, rows: F.inline(F.expr("array({})".format(
        ", ".join("named_struct({})".format(", ".join(f"'{name}{j}', {x}" for j, x in enumerate(row))) for row in rows))))
    rows = lines.select("*", table("_c", combinations(range(parts), edits))).select("*", table("_s", shifts))
    rows = rows.withColumn("_size", F.expr(f"size - _s{edits}"))
    rows = rows.withColumns({"_short": F.expr(f"CAST(floor(_size / {parts}) AS INT)"), "_long": F.expr(f"{parts} - _size % {parts}")})
    start = lambda i: f"_short * ({i}) + greatest(({i}) - _long, 0)"
    rows = rows.withColumns({f"_from{j}": F.expr(start(f"_c{j}")) for j in zones} | {f"_to{j}": F.expr(start(f"_c{j} + 1")) for j in zones})
    ends = [("0", "_from0"), *((f"_to{j}", f"_from{j + 1}") for j in zones[:-1]), (f"_to{edits - 1}", "_size")]
    rows = rows.filter(" AND ".join(f"{x} + _s{j} >= 0 AND {y} + _s{j} <= size" for j, (x, y) in enumerate(ends)))
    runs = ", ".join(f"substring(line, {x} + _s{j} + 1, {y} - {x})" for j, (x, y) in enumerate(ends))
    rows = rows.withColumns({f"_t{j}": F.expr(f"substring(line, _from{j} + _s{j} + 1, _to{j} + _s{j + 1} - _from{j} - _s{j})") for j in zones})
    left = lambda j: f"xxhash64(_t{j})"
    free = lambda j: f"IF(_s{j} = _s{j + 1} AND _c{j} <> {j}, {left(j)}, NULL)"
    chosen = ", ".join(f"_c{j}" for j in zones)
    return rows.select(*lines.columns, F.expr(f"xxhash64(_size, {chosen}, {runs}) AS key"), *(F.expr(f"{(free if probing else left)(j)} AS _z{j}") for j in zones),
                       *(letter_counts(F.col(f"_t{j}")).alias(f"_l{j}") for j in zones), F.expr(f"_s{edits} = 0 AS _even"))


def meetings(probe: DataFrame, index: DataFrame, fit: Column, crowd: int | None) -> DataFrame:
    """(a, b): pairs under one key for which ``fit`` holds; of a key with more than ``crowd`` lines only each line that probes it, without b.

    Never by broadcast: lines make up to thousands of keys each, which Spark's estimate of the size leaves out.
    """
    index = index.hint("merge")
    if crowd is None:
        met = probe.join(index, "key").filter((F.col("a") != F.col("b")) & fit)
    else:
        # The join needs the same rows together in the same order, so the window costs no shuffle. One row stands for a crowd.
        same = Window.partitionBy("key")
        index = index.withColumns({"_many": F.count("*").over(same) > crowd, "_first": F.min("b").over(same)})
        index = index.filter(~F.col("_many") | (F.col("b") == F.col("_first"))).drop("_first")
        met = probe.join(index, "key").filter(F.col("_many") | ((F.col("a") != F.col("b")) & fit))
        met = met.withColumn("b", F.when(~F.col("_many"), F.col("b")))
    # Lines of one length meet both ways round.
    return met.select(F.greatest("a", "b").alias("a"), F.when(F.col("b").isNotNull(), F.least("a", "b")).alias("b")).distinct()


def first_meetings(lines: DataFrame, edits: int) -> DataFrame:
    """(a, b): lines that share a segment where near-equal ones must, and whose letters are as often as in near-equal ones; see meetings for crowds."""
    # Letters are counted before equal lines meet: index and probe then read one exchange and do not count again.
    sized = lines.select("line", "id", F.char_length("line").alias("size"), letter_counts(F.col("line")).alias("_letters")).distinct()
    index = segment_keys(sized, edits).select("key", F.col("id").alias("b"), F.col("_letters").alias("_lb"))
    probe = probe_keys(sized, edits).select("key", F.col("id").alias("a"), F.col("_letters").alias("_la"))
    return meetings(probe, index, letters_apart("_la", "_lb") <= 2 * edits, CROWD)


def with_crowds(met: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """(a, b): the pairs of ``met``, written, and those that lines of its crowds make by finer keys.

    Both lines of a pair that meets in a crowd are among its lines, and finer
    keys lose no pair either, so nothing else is needed of a crowd.
    """
    found = [met.filter("b IS NOT NULL")]
    for parts in FINER:
        crowd = met.filter("b IS NULL").select(F.col("a").alias("id"))
        if crowd.isEmpty():
            break
        # Few lines make very many keys each: they are dealt to all tasks.
        tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        held = only_keys(lines, crowd, ["id"]).select("line", "id", F.char_length("line").alias("size")).distinct()
        held = cut_lineage(held.repartition(tasks, "id"))
        zones = [f"_{c}{j}" for c in "zl" for j in range(edits)]
        index = finer_keys(held, parts, edits, False).select("key", F.col("id").alias("b"), *(F.col(z).alias(f"_b{z}") for z in zones))
        probe = finer_keys(held, parts, edits, True).select("key", F.col("id").alias("a"), "_even", *zones)
        once = ~F.col("_even") | (F.col("a") > F.col("b"))
        free = [F.col(z).isNull() | (F.col(z) != F.col(f"_b{z}")) for z in zones[:edits]]
        apart = reduce(lambda x, y: x + y, (letters_apart(z, f"_b{z}") for z in zones[edits:])) <= 2 * edits
        fit = reduce(lambda x, y: x & y, [once, *free, apart])
        met = cut_lineage(meetings(probe, index, fit, None if parts == FINER[-1] else CROWD))
        found.append(met.filter("b IS NOT NULL"))
    return reduce(DataFrame.unionByName, found).distinct()


def candidate_pairs(lines: DataFrame, edits: int) -> DataFrame:
    """(a, b): of ``lines`` (line, id), those that may be within ``edits`` by their segments and letters."""
    return with_crowds(cut_lineage(first_meetings(lines, edits)), lines, edits)


def cost_within_band(matches: str, final: str, lengths: str, edits: int) -> Column:
    """Edit distance of two lines if it is at most ``edits``, else more; see match_bits for ``matches``.

    A band of 2 * edits + 1 cells runs down the matrix beside the diagonal.
    Its column is held in the bits of two numbers: where a cell exceeds the
    one above by one, and where it falls short of it by one. One addition
    carries matches along the column, and the distance is followed on the
    diagonal that ends in the last cell, which costs one wherever its bit of
    the diagonal zeros is not set. Cells outside the band cost more than
    ``edits`` anyhow.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    start = F.struct(
        F.lit(full & ~((1 << edits) - 1)).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.col(lengths).cast("long").alias("cost")
    )

    def step(s: Column, match: Column) -> Column:
        zero = (((match.bitwiseAND(s["up"]) + s["up"]).bitwiseXOR(s["up"])).bitwiseOR(match).bitwiseOR(s["down"])).bitwiseAND(F.lit(full))
        rise = s["down"].bitwiseOR(F.bitwise_not(zero.bitwiseOR(s["up"])).bitwiseAND(F.lit(full)))
        fall = zero.bitwiseAND(s["up"])
        return F.struct(
            fall.bitwiseOR(F.bitwise_not(F.shiftright(zero, 1).bitwiseOR(rise)).bitwiseAND(F.lit(full))).alias("up"),
            F.shiftright(zero, 1).bitwiseAND(rise).alias("down"),
            (s["cost"] + F.when(zero.bitwiseAND(F.col(final)) == 0, 1).otherwise(0)).cast("long").alias("cost"),
        )

    return F.aggregate(matches, start, step, lambda s: s["cost"])


def match_bits(longer: str, shorter: str, edits: int) -> Column:
    """For each character of the shorter line, which of the characters of the longer in the band equal it: bit o for the one ``o - edits`` places on."""
    at = lambda c, j, o: F.when(F.get(longer, j - edits + o) == c, F.lit(1 << o).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.transform(shorter, lambda c, j: reduce(lambda x, y: x + y, (at(c, j, o) for o in range(2 * edits + 1))))


def pieces_stand(longer: str, shorter: str, edits: int) -> Column:
    """Whether enough pieces of the shorter line stand in the longer one, at most ``edits`` places off.

    An edit spoils one piece at most, and the others move by no more than all edits.
    """
    found = []
    for start, size in segments(F.char_length(shorter), PIECES):
        around = F.substring(longer, F.greatest(start - edits, F.lit(0)) + 1, size + 2 * edits)
        found.append(F.contains(around, F.substring(shorter, start + 1, size)).cast("int"))
    return reduce(lambda x, y: x + y, found) >= PIECES - edits


def verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs within ``edits`` by the banded bit-parallel distance, of those with enough pieces in common: (a, b)."""
    one = texts.select(F.col("id").alias("a"), F.col("line").alias("_one"))
    two = texts.select(F.col("id").alias("b"), F.col("line").alias("_two"))
    rows = bounded(pairs).join(one, "a").join(two.hint("merge"), "b")
    longer = F.char_length("_one") >= F.char_length("_two")
    rows = rows.select("a", "b", F.when(longer, F.col("_one")).otherwise(F.col("_two")).alias("_l"), F.when(longer, F.col("_two")).otherwise(F.col("_one")).alias("_s"))
    rows = cut_lineage(rows.filter(F.char_length("_l") - F.char_length("_s") <= edits).filter(pieces_stand("_l", "_s", edits)))
    chars = lambda c: F.regexp_extract_all(c, F.lit(r"(?s)."), F.lit(0))
    split = cut_lineage(rows.select("a", "b", chars("_l").alias("_l"), chars("_s").alias("_s")))
    extra = F.size("_l") - F.size("_s")
    bits = split.select("a", "b", match_bits("_l", "_s", edits).alias("_m"), extra.alias("_extra"), F.call_function("shiftleft", F.lit(1).cast("long"), extra + edits).alias("_final"))
    return cut_lineage(bits).filter(cost_within_band("_m", "_final", "_extra", edits) <= edits).select("a", "b")


def near_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """Links of different near-equal lines (a, b), and all line rows without text (doc_id, _th, pos, id).

    Lines are known by a 64-bit hash of their text. Equal lines are one, and
    are put together per task before the shuffle, so a line with very many
    copies is one row in the join.
    """
    rows = line_rows(docs)
    lines = rows.filter(F.char_length("line") >= least_chars).select("line", "id")
    met = cut_lineage(first_meetings(lines, edits))
    ids = met.select(F.col("a").alias("id")).unionByName(met.filter("b IS NOT NULL").select(F.col("b").alias("id")))
    texts = cut_lineage(only_keys(rows.select("id", "line"), ids, ["id"]).groupBy("id").agg(F.min("line").alias("line")))
    pairs = cut_lineage(with_crowds(met, texts, edits))
    return cut_lineage(verified(pairs, texts, edits)), rows.drop("line")


def dedup_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, _th, pos, kept, copy, near, links): what happens to every line that is not blank.

    A line is a copy if the same line stands earlier, by doc_id (null last),
    text hash and place; it is near if a different line within ``edits``
    stands first before the first place of this one. Either goes. So every
    line that goes has an equal or a near-equal one before it. links counts
    the different lines within reach.
    """
    links, rows = near_lines(docs, edits, least_chars)
    place = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_th", "pos")
    firsts = rows.groupBy("id").agg(F.min(place).alias("first"))
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    known = bounded(cut_lineage(only_keys(firsts, both, ["id"])))
    reach = both.join(known, "id").join(known.select(F.col("id").alias("other"), F.col("first").alias("_before")), "other")
    reach = cut_lineage(reach.groupBy("id").agg(F.count("*").alias("links"), F.max(F.col("_before") < F.col("first")).alias("near")))
    told = firsts.join(bounded(reach), "id", "left")
    joined = rows.join(told.hint("merge"), "id").withColumns({
        "copy": place != F.col("first"), "near": F.coalesce("near", F.lit(False)), "links": F.coalesce("links", F.lit(0)),
    })
    return joined.select("doc_id", "_th", "pos", (~F.col("copy") & ~F.col("near")).alias("kept"), "copy", "near", "links")


def line_report(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, n_kept, n_copies, n_near and n_links of every document.

    n_lines counts lines that are not blank; n_near those that go only for a
    near-equal line; n_links adds up the different lines within reach of each
    line. Null, empty and blank texts have no lines. Rows alike in id and
    text are one document, and each gets its numbers.
    """
    count = lambda c: F.sum(c.cast("long"))
    told = dedup_lines(docs, edits, least_chars).groupBy("doc_id", "_th").agg(
        F.count("*").alias("n_lines"), count(F.col("kept")).alias("n_kept"), count(F.col("copy")).alias("n_copies"),
        count(F.col("near") & ~F.col("copy")).alias("n_near"), F.sum("links").alias("n_links"),
    )
    every = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))
    every = every.groupBy("_id", "_t").agg(F.count("*").alias("_m"))
    joined = every.join(told.hint("merge"), every["_id"].eqNullSafe(told["doc_id"]) & (every["_t"] == told["_th"]), "left")
    # Rows alike have added up their lines; each gets the numbers of one.
    one = lambda c: F.coalesce((F.col(c) / F.col("_m")).cast("long"), F.lit(0)).alias(c)
    numbers = joined.select(F.col("_id").alias("doc_id"), "_m", *map(one, ("n_lines", "n_kept", "n_copies", "n_near", "n_links")))
    return numbers.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_m")))).drop("_m", "_row")
