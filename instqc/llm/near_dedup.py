"""MinHash near-duplicates: one-permutation hashing, bands and star-shaped candidate links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from instqc.llm.common import bound_batches, carried, digest, only_keys
from instqc.llm.components import components
from instqc.session import cut_lineage

#: Bins of the one permutation, and rows per band: 32 bands of 4.
BINS, ROWS = 128, 4
#: Buckets with at most so many classes have all that the star left apart compared; larger ones get one more centre and a prefix join.
SMALL_BUCKET = 64
#: Counters of shingles, by their lowest bits, that give the prefix join its order.
SLOTS = 1 << 20
#: 64-bit words of the parity bits of a set.
PARITY_WORDS = 8

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Hash of each word seen; emptied when large, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def shingle_set(text: str | None, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles.

    A-Z are lower-cased and words parted at ASCII white space, which is what
    ``bytes`` does. With fewer words than k the whole sequence is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _ODD + hashes[i : len(words) - k + 1 + i])
    return np.unique(out)


@lru_cache(maxsize=1)
def _probes(tries: int = 4096) -> np.ndarray:
    """For every bin the bins from which it borrows if empty, in order of trial."""
    seed = np.arange(tries * BINS, dtype=np.uint64).reshape(tries, BINS)
    return (_mix(_mix(seed + _ODD) + _ODD) >> np.uint64(32)).astype(np.int64) % BINS


def signature(hashes: np.ndarray) -> np.ndarray:
    """One-permutation sketch of a sorted set, empty bins filled by optimal densification.

    The top bits of a hash name its bin and the least hash of a bin is its
    value. An empty bin follows its own fixed random sequence of bins to the
    first that is not empty, independently of the other empty bins.
    """
    bins = (hashes >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    values = np.zeros(BINS, np.uint64)
    values[bins[first]] = hashes[first]
    filled = np.zeros(BINS, bool)
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    source = np.arange(BINS)
    for tries in (8, 64, 512, 4096):
        if not len(empty):
            break
        found = filled[_probes()[:tries, empty]]
        hit = found.any(axis=0)
        source[empty[hit]] = _probes()[found.argmax(axis=0)[hit], empty[hit]]
        empty = empty[~hit]
    for bin_ in empty:  # all tries failed: the next filled bin, in a circle
        source[bin_] = (bin_ + 1 + np.argmax(np.roll(filled, -bin_ - 1))) % BINS
    return values[source]


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate([np.empty(0, np.int64), *(a.view(np.int64) for a in arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def band_hashes(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return hashes
    rows = signature(hashes).reshape(-1, ROWS)
    out = np.arange(1, len(rows) + 1, dtype=np.uint64) * _ODD
    for i in range(ROWS):
        out = _mix(out * _ODD + rows[:, i])
    return out


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with _key (of the shingle set), _n (its size) and _bands; no text unless kept."""
    kept = docs.select(*keep, F.col("text").alias("_text"))
    schema = kept.drop("_text").schema.add("_key", "binary").add("_n", "long").add("_bands", ArrayType(LongType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            keys, sizes, bands = [], [], []
            for text in batch.column(batch.num_columns - 1):
                s = shingle_set(text.as_py(), k, cache)
                keys.append(set_key(s))
                sizes.append(len(s))
                bands.append(band_hashes(s))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists(bands)],
                names=schema.names,
            )

    return kept.mapInArrow(work, schema)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(key, items): the shingle set of each text, for the exact check."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            found = [shingle_set(text.as_py(), k, cache) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in found], pa.binary()), lists(found)],
                names=["key", "items"],
            )

    return docs.select("text").mapInArrow(work, "key binary, items array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets meet the similarity threshold; only sets of these pairs are shuffled."""
    ends = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key")))
    sets = only_keys(sets, ends, ["key"])
    left = sets.select(F.col("key").alias("u"), F.col("items").alias("_a"))
    right = sets.select(F.col("key").alias("v"), F.col("items").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return (
        pairs.join(left, "u").join(right, "v").withColumn("_both", both)
        .filter(100 * F.col("_both") >= percent * (F.size("_a") + F.size("_b") - F.col("_both"))).select("u", "v")
    )


def parity(hashes: np.ndarray) -> np.ndarray:
    """Every item of a set turns over one of 64 * PARITY_WORDS bits, named by its lowest bits."""
    counts = np.bincount((hashes & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<u8")


def own_roots(sets: DataFrame) -> DataFrame:
    """(node, root, bits): every class as a component of its own, with the parity bits of its set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [parity(items.values.to_numpy().view(np.uint64)) for items in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), lists(bits)], names=["node", "root", "bits"])

    return sets.select("key", "items").mapInArrow(work, "node binary, root binary, bits array<bigint>")


def may_fit(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, n, bits, v, m, _bits) that sizes and parity bits do not rule out.

    The bits in which two sets differ are the parity of what only one of them
    holds, so they are never more than that. A pair that fits has at most
    (100 - percent) / (100 + percent) of both sizes in one set only.
    """
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("_bits", F.lit(i)))) for i in range(PARITY_WORDS)))
    sized = pairs.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return sized.filter((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("m")))


def centre_pairs(placed: DataFrame, draws: range) -> DataFrame:
    """Members of each bucket paired with the centres that they are not connected with: (u, n, bits, v, m, _bits).

    One centre per draw: draw 0 takes the least key, others the least hash of key and draw.
    """
    def centre(number: int):
        draw = F.lit(0).cast("long") if number == 0 else F.xxhash64("key", F.lit(number))
        return F.min(F.struct(draw.alias("_o"), F.col("key"), F.col("root"), F.col("n"), F.col("bits"))).alias(f"_c{number}")

    centres = placed.groupBy("bucket").agg(*map(centre, draws)).select("bucket", F.explode(F.array(*(f"_c{i}" for i in draws))).alias("_c"))
    centres = centres.select("bucket", F.col("_c.key").alias("v"), F.col("_c.root").alias("_root"), F.col("_c.n").alias("m"), F.col("_c.bits").alias("_bits"))
    return placed.join(centres, "bucket").filter("root <> _root").select(F.col("key").alias("u"), "n", "bits", "v", "m", "_bits")


def small_pairs(placed: DataFrame) -> DataFrame:
    """All pairs that small buckets leave apart; a bucket of b classes has fewer than b * SMALL_BUCKET."""
    other = placed.select("bucket", F.col("key").alias("v"), F.col("root").alias("_root"), F.col("n").alias("m"), F.col("bits").alias("_bits"))
    return placed.join(other, "bucket").filter((F.col("key") > F.col("v")) & (F.col("root") != F.col("_root"))).select(F.col("key").alias("u"), "n", "bits", "v", "m", "_bits")


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many items fall into each slot; added up per task, so at most SLOTS rows of each are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy() & (SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    found = sets.select("items").mapInArrow(work, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def prefix_rows(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(token, at, key, root, n, bits, short): the first items of each set, rarest first.

    A set that fits another shares with it one of its first n - need + 1
    items, need being the least possible intersection. With a set no smaller
    than itself need is greater, and the items marked ``short`` are enough.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places, picks, short = [], [], [], []
            for i, items in enumerate(batch.column(2)):
                items = items.values.to_numpy()
                n = len(items)
                first = items[np.lexsort((items, counts[items & (SLOTS - 1)]))][: n + 1 + -percent * n // 100]
                tokens.append(first)
                places.append(np.arange(len(first)))
                picks.append(np.full(len(first), i))
                short.append(places[-1] < n + 1 + -2 * percent * n // (100 + percent))
            if not tokens:
                continue
            picks = pa.array(np.concatenate(picks))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(places)), *(batch.column(i).take(picks) for i in (0, 1, 3, 4)), pa.array(np.concatenate(short))],
                names=["token", "at", "key", "root", "n", "bits", "short"],
            )

    rows = sets.select("key", "root", "items", F.size("items").cast("long").alias("n"), "bits")
    return rows.mapInArrow(work, "token long, at long, key binary, root binary, n long, bits array<bigint>, short boolean")


def prefix_pairs(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes in ``placed`` that are apart and may fit: (u, n, bits, v, m, _bits).

    An exact prefix join of their full sets with size and positional filters.
    Its order is by counts of slots, which several shingles may share; any
    order is right, and the rarer the first items are, the fewer the pairs.
    """
    apart = placed.select("key", "root", "bits").distinct()
    chosen = cut_lineage(only_keys(sets, apart, ["key"]).join(apart, "key"))
    rows = cut_lineage(prefix_rows(chosen, slot_counts(chosen), percent))
    index = rows.filter("short").select("token", F.col("at").alias("_at"), F.col("key").alias("v"), F.col("root").alias("_root"), F.col("n").alias("m"), F.col("bits").alias("_bits"))
    pairs = rows.join(index, "token").filter("root <> _root AND (n > m OR n = m AND key > v)").filter(100 * F.col("m") >= percent * F.col("n"))
    # Behind the first item shared there must be enough left of both.
    pairs = pairs.filter((100 + percent) * F.least(F.col("n") - F.col("at"), F.col("m") - F.col("_at")) >= percent * (F.col("n") + F.col("m")))
    return pairs.select(F.col("key").alias("u"), "n", "bits", "v", "m", "_bits")


def star_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components of the classes in shared buckets by confirmed links: (node, root).

    ``members(bucket, key, n)`` lists classes of different sets. In every
    bucket one class is the centre and the others are compared with it alone,
    so pairs are as many as rows, however large a bucket is. A class may be
    like another member and not like the centre. So buckets whose classes are
    not all connected then come up again: small ones with every pair that is
    still apart, large ones with one more centre and, where that leaves
    classes apart, with an exact prefix join of these. After it every pair of
    a bucket that fits is connected. Links are told from other pairs by the
    full sets, and of pairs only those that the bits of both do not rule out.
    Components met before are one node when new links are contracted.
    """
    label = cut_lineage(own_roots(sets))
    tried = None
    for step in ("star", "small", "rest"):
        placed = members.join(label, members["key"] == label["node"]).drop("node")
        if step == "star":
            pairs = centre_pairs(placed, range(1))
        else:
            apart = placed.groupBy("bucket").agg(F.count("*").alias("_size"), F.min("root").alias("_lo"), F.max("root").alias("_hi"))
            placed = cut_lineage(placed.join(apart.filter("_lo <> _hi").select("bucket", "_size"), "bucket"))
            large = placed.filter(F.col("_size") > SMALL_BUCKET)
            if step == "small":
                pairs = centre_pairs(large, range(1, 2)).unionByName(small_pairs(placed.filter(F.col("_size") <= SMALL_BUCKET)))
            elif large.take(1):
                pairs = prefix_pairs(large, sets, percent)
            else:
                break
        pairs = may_fit(pairs, percent).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = cut_lineage(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = cut_lineage(confirmed(pairs, sets, percent))
        if not new.take(1):
            continue
        at = lambda end: label.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
        if step != "star":
            new = new.join(at("v"), "v").join(at("u"), "u").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
        roots = components(new).select(F.col("node").alias("root"), F.col("root").alias("_new"))
        label = cut_lineage(label.join(roots, "root", "left").select("node", F.coalesce("_new", "root").alias("root"), "bits"))
    return label.select("node", "root")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Every document with n_shingles, component_id and kept.

    Links join texts whose sets of k-word shingles have
    ``100 * intersection >= percent * union``; component_id is the smallest
    doc_id of all documents that links reach. Documents without words have no
    shingles, are linked with nothing and stand for themselves. Equal sets are
    one class, named by a digest of the set, so exact copies, repeated rows
    and repeated or null ids add no pairs; null ids count only if a component
    has no other. kept is doc_id = component_id, null ids included.

    Texts are read twice: once for sketches, and once more for the full sets
    of one member of each class that shares a bucket with another class.
    """
    return grouped(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """As near_duplicates, with _root (null without words) and _th, the digest of the text."""
    bound_batches(docs.sparkSession)
    base = docs.select("doc_id", "text", digest(F.col("text")).alias("_th"))
    sketched = cut_lineage(sketches(base, k, ["doc_id", "_th"]))
    # A band hash of an equal set is equal too: the first of any is enough.
    classes = cut_lineage(
        sketched.filter("_n > 0").groupBy("_key").agg(
            F.min("doc_id").alias("low"), F.min("_th").alias("_th"), F.max("_n").alias("n"), F.max("_bands").alias("_bands")
        )
    )
    banded = classes.select("_key", "n", F.explode("_bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("_m")).filter("_m > 1").select("bucket")
    members = cut_lineage(banded.join(shared, "bucket").select("bucket", F.col("_key").alias("key"), "n"))
    wanted = only_keys(classes, members.select(F.col("key").alias("_key")), ["_key"]).select("_th")
    sets = cut_lineage(full_sets(only_keys(base.select("text", "_th"), wanted, ["_th"]).dropDuplicates(["_th"]), k).dropDuplicates(["key"]))
    roots = star_components(members, sets, percent)
    rooted = classes.select("_key", "low").join(roots, F.col("_key") == F.col("node"), "left").select("_key", "low", F.coalesce("root", "_key").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("_key", "component_id", F.col("root").alias("_root"))
    linked = sketched.drop("_bands").join(named, "_key", "left")
    own = F.when(F.col("_n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return linked.select(
        "doc_id", "_th", "_root", F.col("_n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all columns as given.

    The row with the smallest doc_id stays; of rows with that id, one with the
    least text digest. Rows without words stay, except that of rows alike in
    id and text one stays. Null ids stand behind all others. Further columns,
    whatever their names, come through as they are.
    """
    marked = grouped(docs, k, percent).filter("kept")
    alone = marked.filter("_root IS NULL").select("doc_id", "_th")
    first = marked.filter("_root IS NOT NULL").groupBy("_root").agg(F.min(F.struct("doc_id", "_th")).alias("_one")).select("_one.*")
    kept = first.unionByName(alone).distinct().withColumnsRenamed({"doc_id": "_id", "_th": "_kept_th"})
    keyed = docs.select(carried(docs), F.col("doc_id").alias("_doc"), digest(F.col("text")).alias("_th"))
    same = keyed["_doc"].eqNullSafe(kept["_id"]) & (keyed["_th"] == kept["_kept_th"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["_doc", "_th"]).select("_row.*")
