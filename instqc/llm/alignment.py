"""Alignment of two tokenizers by diagonal run skipping, and counts of linked ids over the corpus."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType

from instqc.llm.arrow import Rows, values
from instqc.session import cut_lineage

#: An id pair is held in all tasks if it has at least one in so many of the corpus' links, so at most so many pairs are.
HOT_PAIRS = 200_000
#: First block of a probe, in tokens; it doubles while the blocks agree.
PROBE = 4

#: What is counted of a document's links: both ids and how often they are linked.
PAIR = ("a", "b", "n")


@lru_cache(maxsize=1)
def _tokenizers(ranks: str, pattern: str, pieces: str):
    """Both tokenizers and the byte length of each of their ids."""
    import sentencepiece
    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=pieces)
    a_bytes = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        a_bytes[rank] = token
    b_bytes = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    return a, b, a_bytes, b_bytes


def runs(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Where two rising arrays of ends meet, as runs (i, j, n): a[i + t] = b[j + t] for t below n.

    From a meeting point on, the ends are compared at the current index shift:
    a block of PROBE ends, then blocks of doubled size while they agree, then
    halves of the block that does not, which jumps over a one-to-one stretch
    in few comparisons of memory. Where the stretch ends, the group at hand is
    resolved token by token: whichever array lags is advanced until both ends
    agree, which sets the shift for the next run. Both arrays must have the
    same last end.
    """
    left, right = a.tolist(), b.tolist()
    a_bytes, b_bytes = a.tobytes(), b.tobytes()
    width = a.itemsize
    starts_a, starts_b, lengths = [], [], []
    i = j = n = 0  # the run at hand starts at (i, j) and has n ends so far
    while True:
        limit = min(len(left) - i, len(right) - j)
        x, y = i * width, j * width
        step = PROBE
        while n < limit and a_bytes[x + n * width : x + (n + step) * width] == b_bytes[y + n * width : y + (n + step) * width]:
            n = min(n + step, limit)
            step *= 2
        while step > 1 and n < limit:
            step //= 2
            if n + step <= limit and a_bytes[x + n * width : x + (n + step) * width] == b_bytes[y + n * width : y + (n + step) * width]:
                n += step
        if n:
            starts_a.append(i)
            starts_b.append(j)
            lengths.append(n)
        i, j = i + n, j + n
        if i >= len(left) or j >= len(right):
            return starts_a, starts_b, lengths
        x, y = left[i], right[j]
        while x != y:
            if x < y:
                i += 1
                x = left[i]
            else:
                j += 1
                y = right[j]
        n = 1


def cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the last token of every group, in both arrays of ends."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j, n = (np.array(x, np.int64) for x in runs(a, b))
    within = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
    return np.repeat(i, n) + within, np.repeat(j, n) + within


def decimals(n: int) -> np.ndarray:
    """Digits of 0 to n - 1 in rows of equal width, with a last column for the sign behind; zero bytes are no text."""
    width = len(str(n))
    out = np.zeros((n, width + 1), np.uint8)
    ids = np.arange(n)
    for k in range(width):
        digit = ids // 10 ** (width - 1 - k)
        out[:, k] = np.where((digit > 0) | (k == width - 1), digit % 10 + 48, 0)
    return out


def written(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, digits: np.ndarray) -> bytes:
    """The groups as text: ids of either side joined by commas, sides by a bar, groups by semicolons."""
    place_a = np.arange(len(a)) + np.repeat(np.r_[0, cut_b[:-1] + 1], np.diff(cut_a, prepend=-1))
    place_b = np.arange(len(b)) + np.repeat(cut_a + 1, np.diff(cut_b, prepend=-1))
    out = np.empty((len(a) + len(b), digits.shape[1]), np.uint8)
    out[place_a], out[place_b] = digits[a], digits[b]
    out[:, -1] = ord(",")
    out[place_a[cut_a], -1] = ord("|")
    out[place_b[cut_b], -1] = ord(";")
    flat = out.ravel()[:-1]
    return flat[flat != 0].tobytes()


def align(docs: DataFrame, ranks: str, pattern: str, pieces: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, groups, pairs, and ``row``, a number of its own.

    A encodes a space and the text with the byte-level vocabulary ``ranks``
    (splitting by ``pattern``), B the text with the model ``pieces``, which
    puts the space itself; both are paths on the driver and sent to the
    executors. Offsets in bytes where tokens of both end cut them into groups;
    ``groups`` lists the ids of each as ``a1,a2|b1;a3|b2,b3``. The last tokens
    of a group end together and are linked; no token is empty, so a group has
    one link. ``pairs`` counts the linked ids of the document.

    Null and empty texts, and texts of which either side does not give back
    the bytes, have no tokens: zeros, and groups and pairs that are empty. Rows
    are aligned one by one, whatever their doc_id; other columns are not read;
    a long text needs memory in proportion to it; an empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    names = []
    for path in (ranks, pieces):
        context.addFile(path)
        names.append(os.path.basename(path))
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = given.select("doc_id").schema
    for column, kind in (("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("groups", "string"), *((name, ArrayType(IntegerType())) for name in PAIR)):
        schema = schema.add(column, kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, a_bytes, b_bytes = _tokenizers(SparkFiles.get(names[0]), pattern, SparkFiles.get(names[1]))
        a_sizes, b_sizes = (np.array(list(map(len, table)), np.int32) for table in (a_bytes, b_bytes))
        digits = decimals(max(len(a_bytes), len(b_bytes)))
        rows = Rows(to_arrow_schema(schema))
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), values(batch.column(1))):
                whole = b" " + raw
                text = raw.decode()
                ids_a, ids_b = (a.encode_ordinary(" " + text), b.encode(text)) if text else ([], [])
                if b"".join(map(b_bytes.__getitem__, ids_b)) != whole or b"".join(map(a_bytes.__getitem__, ids_a)) != whole:
                    rows.add((doc_id, 0, 0, 0, "", [], [], []), 64)
                else:
                    ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
                    cut_a, cut_b = cuts(a_sizes[ids_a].cumsum(dtype=np.int64), b_sizes[ids_b].cumsum(dtype=np.int64))
                    groups = written(ids_a, ids_b, cut_a, cut_b, digits)
                    pairs, counts = np.unique(ids_a[cut_a] << 32 | ids_b[cut_b], return_counts=True)
                    listed = [x.astype(np.int32) for x in (pairs >> 32, pairs & 0xFFFFFFFF, counts)]
                    rows.add((doc_id, len(ids_a), len(ids_b), len(cut_a), groups.decode(), *listed), len(groups) + 12 * len(pairs) + 64)
                if rows.full():
                    yield rows.batch()
        yield rows.batch()

    return given.mapInArrow(work, schema).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "groups", F.arrays_zip(*PAIR).alias("pairs"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, links, best): how many links of the corpus hold each id pair, and whether no pair of its b has more."""
    counts = cut_lineage(aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum(F.col("n").cast("long")).alias("links")))
    top = counts.groupBy("b").agg(F.max("links").alias("_top"))
    return counts.join(top, "b").select("a", "b", "links", (F.col("links") == F.col("_top")).alias("best"))


def link_scores(aligned: DataFrame) -> DataFrame:
    """Adds n_links, n_best and count_sum to every row of ``aligned``, a written table without the groups if they are not needed.

    Few pairs make up most links. Those with at least one in HOT_PAIRS of all
    links, which cannot be more than HOT_PAIRS, are broadcast; the others are
    joined by shuffle, where no key has more than that share of the links.
    """
    counts = cut_lineage(pair_counts(aligned))
    total = counts.agg(F.sum("links")).first()[0] or 0
    hot = F.col("links") * HOT_PAIRS >= total
    often, seldom = F.broadcast(counts.filter(hot)), counts.filter(~hot)
    links = aligned.select("row", F.inline("pairs"))
    scores = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * F.col("links")).cast("long").alias("count_sum")]
    first = links.join(often, ["a", "b"]).groupBy("row").agg(*scores)
    rest = links.join(often.select("a", "b"), ["a", "b"], "left_anti").join(seldom, ["a", "b"]).groupBy("row").agg(*scores)
    sums = first.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return aligned.join(sums, "row", "left").select(*aligned.columns, F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"))
