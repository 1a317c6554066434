"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from instqc.llm.common import attach
from instqc.session import cut_lineage

#: About so many labelled documents of each kind, drawn by hash, are learnt from; the bounds do not grow with the corpus.
TOXIC_SAMPLE, ORDINARY_SAMPLE = 2000, 4000
#: Every window begins with it and both dictionaries hold it, so that even a window of one word starts with a match;
#: what follows the word is in neither, as zstandard seeks no match in the last eight bytes of its input.
FRAME, TAIL = b"<0123456789/9876543210>", b"\x01\x02\x03\x04\x05\x06\x07\x08\x0b"
#: Bytes that a window must save to count.
LEAST_GAIN = 3
#: Added to the number of words of a text.
STEADY = 50
#: Bytes of the dictionary that both sides share, and most that one side adds.
SHARED_BYTES, SIDE_BYTES = 16384, 4096
#: Only matches of so many bytes count, which a short word with its blanks has and most chance matches lack.
PARAMETERS = zstandard.ZstdCompressionParameters(
    window_log=17, hash_log=15, chain_log=15, search_log=1, min_match=5, target_length=1, strategy=zstandard.STRATEGY_DFAST,
    write_content_size=False, write_checksum=False, write_dict_id=False,
)
#: A word is typical of one kind if its documents are of that kind beyond chance by so many units of log-likelihood.
TYPICAL = 12.0
#: Documents that score at least this are called toxic.
THRESHOLD = 0.3


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def window(word: bytes) -> bytes:
    """A word between blanks, as words lie in the dictionaries.

    With one word to a window, a window saves bytes only if nearly the whole
    word is in a dictionary; in longer ones chance matches of neighbours
    outweigh a short word. Words recur, so their lengths need not be taken
    again.
    """
    return FRAME + b" " + word + b" " + TAIL


def _documents(docs: list[list[bytes]], chosen: set[bytes] | None = None, seen: set | None = None) -> Counter:
    """In how many documents each word stands; with ``seen``, between neighbours not seen before.

    Copies repeat the neighbours of a word, so they do not count again.
    """
    out: Counter = Counter()
    for words in docs:
        if chosen is None:
            out.update(set(words))
            continue
        new = set()
        for before, word, after in zip([b"", *words], words, [*words[1:], b""]):
            if word in chosen and (before, word, after) not in seen:
                seen.add((before, word, after))
                new.add(word)
        out.update(new)
    return out


def typical_words(docs: list[list[bytes]], others: list[list[bytes]]) -> list[bytes]:
    """Words that stand in ``docs`` far more often than in ``others``, the surest last."""
    here, there = _documents(docs), _documents(others)
    base = len(docs) / max(1, len(docs) + len(others))

    def surprise(a: int, b: int) -> float:
        share = a / (a + b) if a else 0.0
        if share <= base or not 0 < base < 1:
            return 0.0
        return a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0.0)

    chosen = {w for w, n in here.items() if len(w) > 2 and surprise(n, there[w]) >= TYPICAL}
    seen: set = set()
    apart, common = _documents(docs, chosen, seen), _documents(others, chosen, seen)
    kept = sorted((surprise(apart[w], common[w]), w) for w in chosen)
    return [w for value, w in kept if value >= TYPICAL]


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on the samples; their plain end if they are too few to train on."""
    whole = b"".join(samples)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return whole[-size:]


def side(words: list[bytes], size: int = SIDE_BYTES) -> bytes:
    """What one side adds: its typical words, the surest nearest to the end, where offsets are short."""
    return b"".join(b" " + w + b" " for w in words)[-size:]


@dataclass
class Distance:
    """Two dictionaries with one common part, and the calibration of what they tell apart.

    As the common part is the same, the two lengths of a window differ only
    by what the toxic or the ordinary part alone can express.
    """

    toxic: bytes
    ordinary: bytes
    bounds: list[float]
    chances: list[float]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        def of(content: bytes) -> zstandard.ZstdCompressor:
            table = zstandard.ZstdCompressionDict(FRAME + b"\0" + content + TAIL[::-1], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            table.precompute_compress(compression_params=PARAMETERS)
            return zstandard.ZstdCompressor(dict_data=table, compression_params=PARAMETERS)

        return of(self.toxic), of(self.ordinary)

    def chance(self, gain: float) -> float:
        return self.chances[bisect_right(self.bounds, gain)]


class Saved(dict):
    """Bytes that the toxic dictionary saves over the ordinary one, by word."""

    def __init__(self, model: Distance):
        super().__init__()
        self.toxic, self.ordinary = model.compressors()

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        text = window(word)
        value = self[word] = len(self.ordinary.compress(text)) - len(self.toxic.compress(text))
        return value


def gain(words: list[bytes], saved: Saved) -> float:
    """Bytes saved in all windows that save enough to count, by word; STEADY words more keep short texts apart from chance."""
    return sum(s for s in map(saved.__getitem__, words) if s >= LEAST_GAIN) / (len(words) + STEADY)


def calibrate(gains: list[tuple[float, float, int]]) -> tuple[list[float], list[float]]:
    """Monotone chances of being toxic from (gain, weight, label): neighbours are pooled until chances rise."""
    blocks: list[list[float]] = []  # start, toxic weight, weight
    for value, weight, label in sorted(gains):
        if blocks and blocks[-1][0] == value:
            blocks[-1][1] += weight * label
            blocks[-1][2] += weight
        else:
            blocks.append([value, weight * label, weight])
    pooled: list[list[float]] = []
    for block in blocks:
        pooled.append(block)
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            last = pooled.pop()
            pooled[-1][1] += last[1]
            pooled[-1][2] += last[2]
    if not pooled:
        return [], [0.0]
    total = sum(b[2] for b in pooled)
    base = sum(b[1] for b in pooled) / total
    # A twentieth of a per cent of all weight is added at the base rate, so no chance is 0 or 1.
    extra = 0.0005 * total
    chances = [(b[1] + extra * base) / (b[2] + extra) for b in pooled]
    return [b[0] for b in pooled[1:]], chances


def learn(rows: Iterable[tuple[str | None, int]], toxic_share: float) -> Distance:
    """Dictionaries from three quarters of the labelled texts, calibration on the rest."""
    parts: dict[tuple[int, int], list[list[bytes]]] = defaultdict(list)
    for number, (text, label) in enumerate(sorted(set(rows), key=lambda r: (r[1], r[0] or ""))):
        parts[label, int(number % 4 == 3)].append(tokens(text))
    bad, good = parts[1, 0], parts[0, 0]
    common = trained([b" ".join(words[i : i + 16]) + b" " for words in good for i in range(0, len(words), 16)], SHARED_BYTES)
    toxic, plain = side(typical_words(bad, good)), side(typical_words(good, bad))
    model = Distance(common + toxic, common + plain[-max(len(toxic), 1) :], [], [0.0])
    saved = Saved(model)
    weight = {1: toxic_share / max(1, len(parts[1, 1])), 0: (1 - toxic_share) / max(1, len(parts[0, 1]))}
    model.bounds, model.chances = calibrate([(gain(words, saved), weight[label], label) for label in (0, 1) for words in parts[label, 1]])
    return model


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, ordinary_sample: int = ORDINARY_SAMPLE) -> Distance:
    """Learn from about so many labelled documents outside the held-out part as the bounds say.

    Labels are counted whole; the sample is those whose hash of the id falls
    below the share that gives the bound. Only its texts reach the driver.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("_label")).filter("doc_id IS NOT NULL AND _label IN (0, 1)").filter(~held_out())
    known = cut_lineage(known.groupBy("doc_id").agg(F.max("_label").alias("_label")))
    n = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if not n:
        return Distance(b" ", b" ", [], [0.0])
    share = {1: min(1.0, toxic_sample / n.get(1, 1)), 0: min(1.0, ordinary_sample / n.get(0, 1))}
    bound = F.when(F.col("_label") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bound)
    rows = attach(docs.select("doc_id", "text"), drawn, ["doc_id"], ["text"]).select("text", "_label").collect()
    return learn([(r["text"], r["_label"]) for r in rows], n.get(1, 0) / sum(n.values()))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    The score is the calibrated chance of label 1 by the text alone, from 0
    to 1; null and empty texts have no window and get the chance of no gain.
    Repeated rows score alike. Without labels every score is 0.
    """
    model = fit(docs, labels)

    @F.pandas_udf(DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        saved = Saved(model)
        for texts in parts:
            yield pd.Series([model.chance(gain(tokens(t), saved)) for t in texts], dtype="float64")

    scored = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
