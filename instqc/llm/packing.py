"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from instqc.llm.arrow import Rows, values
from instqc.llm.common import with_position

#: Longest sequence; a power of two.
LONGEST = 4096
#: The id that ends a document.
END = 2
#: Words of which the ids are kept at hand per task, twice over.
WORDS_KEPT = 300_000

# One pre-token whatever stands around it: letters of ASCII and Latin-1 have a
# lower case of one character and are never recomposed.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
# Marks that end a run of letters and start no contraction or special token.
_CLOSING = ".,;:!?$%&#*()[]\"-"
_CASE_MATTERS = (b"<|", b"\xcc", b"\xcd")
# A mark that ends a word of letters and stands alone: its own pre-token.
_SENTENCE_MARK = re.compile(rb"(?<=[a-z])([.,])(?=\s|$)")


def byte_symbols() -> dict[int, str]:
    """Byte to the character that stands for it in byte-level vocabularies: itself if printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds(dict):
    """Little-endian 32-bit ids of each word seen.

    This tokenizer drops white space, lets nothing pass across it and lowers
    case, so the ids of a text are those of its words in lower case. A word of
    plain letters is one pre-token and goes straight to the tokenizer's model;
    closing marks behind one are looked up apart; everything else takes the
    whole tokenizer. Of two generations of WORDS_KEPT words the older is
    dropped when the newer is full, and long words are not kept, so memory
    stays bounded.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.symbols = byte_symbols()
        self.older: dict[bytes, bytes] = {}

    def of_text(self, text: bytes) -> bytes:
        # Case matters for special tokens, and for letters that marks are put on (U+0300 to U+037F) before it is lowered.
        if not any(sign in text for sign in _CASE_MATTERS):
            text = _SENTENCE_MARK.sub(rb" \1", text.lower())
        return b"".join(map(self.__getitem__, text.split()))

    def encoded(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():
            return pack_ids([t.id for t in self.tokenize(word.decode())])
        text = word.decode("utf-8", "replace")
        lower = text.lower()
        letters = lower.rstrip(_CLOSING)
        if not _LETTERS.fullmatch(letters):
            return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if letters != text:
            return self[letters.encode()] + (self[lower[len(letters):].encode()] if letters != lower else b"")
        return pack_ids([t.id for t in self.tokenize(word.decode("latin-1").translate(self.symbols))])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encoded(word)
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cut(n: int, longest: int) -> Iterator[int]:
    """Lengths of the pieces of a document: as many of ``longest`` as fit, then the powers of two of the rest, falling."""
    for _ in range(n // longest):
        yield longest
    rest = n % longest
    while rest:
        piece = 1 << (rest.bit_length() - 1)
        yield piece
        rest -= piece


def pack(docs: DataFrame, tokenizer: str, *, longest: int = LONGEST, end_id: int = END) -> DataFrame:
    """One row per sequence: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``tokenizer`` is the path of the tokenizer file on the driver; it is sent
    to the executors. A document is the ids of its text and ``end_id``; null
    and empty texts are that one id. Its length is written in binary and the
    document cut at its set bits, after whole sequences of ``longest``. Every
    piece is a sequence of its own: its length, a power of two, is its bucket,
    so batches of one bucket hold equal lengths, nothing is padded, and no
    sequence crosses documents. ``ids`` are little-endian unsigned 32-bit.

    One pass without a shuffle: a long document or a hot source is spread as
    the files are. Words, not documents, are held in tasks. Rows with one
    doc_id, or none, are packed apart; other columns are not read; an empty
    table gives no rows.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = given.select("doc_id").schema.add("start", "long").add("length", "long").add("doc_tokens", "long").add("ids", "binary")
    end = pack_ids([end_id])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(SparkFiles.get(name))
        rows = Rows(to_arrow_schema(schema))
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), values(batch.column(1))):
                ids = known.of_text(text) + end
                n, start = len(ids) // 4, 0
                for length in cut(n, longest):
                    rows.add((doc_id, start, length, n, ids[4 * start : 4 * (start + length)]), 4 * length + 64)
                    start += length
                    if rows.full():
                        yield rows.batch()
        yield rows.batch()

    pieces = given.mapInArrow(work, schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes sequences as one folder per length, straight from the tasks that cut them."""
    packed.write.partitionBy("length").parquet(path)


def batches(packed: DataFrame, batch_tokens: int) -> DataFrame:
    """(sequence_id, length, batch_id, place): batches of one length each, with ``batch_tokens`` ids or, the last, fewer.

    ``packed`` must be a written table. Sequences of a length are taken in the
    order of a hash; positions come from counted parts, so no task holds a
    whole bucket. A batch takes at least one sequence.
    """
    narrow = packed.select("sequence_id", "length").withColumn("_cell", F.lit(0))
    placed = with_position(narrow, ["length"], ["_cell"], ["sequence_id"], narrow.count())
    each = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))
    return placed.select(
        "sequence_id", "length", F.floor(F.col("_position") / each).cast("long").alias("batch_id"), F.pmod("_position", each).cast("long").alias("place"))
