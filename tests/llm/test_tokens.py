"""Packing and alignment of tokenizers, against plain versions."""

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from instqc.llm import alignment, packing
from instqc.llm.queries import op11_packing, op12_alignment
from instqc.session import cut_lineage

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    None, "", " \n", "don't 'TIS it's", "É É ñandú Straße $$$word$$$ word.\"'s", "<|endoftext|> <|ENDOFTEXT|>x", "x≠ \x1c\x85\xa0y", "文字 😀 текст▁",
    "a" * 5000, "one two  three\tfour\r\n" * 900, "İstanbul ΣΑΣ KÅ", "<0x41> \x00 ​", " leading", "trailing ",
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i % 9 if i else None, text) for i, text in enumerate(HARD * 2)]
    return cut_lineage(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS row", "2 AS length", "3 AS pairs"))


def word_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def joined(rows):
    """The documents that pieces make up, by doc_id and start; each must be gapless."""
    docs = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"])):
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    return docs


def test_pack_round_trip(hard):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = packing.pack(hard, WORDS).collect()
    expected = Counter((i % 9 if i else None, tuple(word_ids(tokenizer, text))) for i, text in enumerate(HARD * 2))
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    got, ids = Counter(), []
    for r in sorted(rows, key=lambda r: r["sequence_id"]):
        piece = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(piece) == r["length"] and r["length"] & (r["length"] - 1) == 0 and r["length"] <= packing.LONGEST and r["offset"] == 0
        assert r["start"] == len(ids)
        ids += piece
        if len(ids) == r["doc_tokens"]:
            got[r["doc_id"], tuple(ids)] += 1
            ids = []
    assert got == expected and not ids


@given(st.integers(1, 100_000), st.sampled_from([1, 8, 4096]))
def test_cut(n, longest):
    pieces = list(packing.cut(n, longest))
    assert sum(pieces) == n and pieces == sorted(pieces, reverse=True)
    assert all(p & (p - 1) == 0 and p <= longest for p in pieces)
    rest = [p for p in pieces if p < longest]
    assert len(set(rest)) == len(rest)


def test_packing_query(spark, folder):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = op11_packing(spark, folder).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert set(pieces) == {d["doc_id"] for d in docs}
    for d in docs:
        ids, at = word_ids(tokenizer, d["text"]), 0
        for r in sorted(pieces[d["doc_id"]], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += r["length"]
        assert at == len(ids)


def test_batches_and_buckets(spark, hard, tmp_path):
    path = str(tmp_path / "buckets")
    packing.write_buckets(packing.pack(hard, WORDS), path)
    packed = spark.read.parquet(path)
    assert {r["length"] for r in packed.select("length").distinct().collect()} == {len(r["ids"]) // 4 for r in packed.select("ids").collect()}
    batches = packing.batches(packed, 4096).collect()
    groups = {}
    for r in batches:
        groups.setdefault((r["length"], r["batch_id"]), []).append(r["place"])
    assert len(batches) == packed.count()
    for (length, batch), places in groups.items():
        assert sorted(places) == list(range(len(places)))
        last = batch == max(b for n, b in groups if n == length)
        assert len(places) <= 4096 // length and (last or len(places) == 4096 // length)


def test_pack_nothing(spark, empty):
    assert packing.pack(empty, WORDS).collect() == []
    with pytest.raises(ValueError):
        packing.pack(empty, WORDS, longest=100)


def plain(rows):
    """The result of alignment by whole sets of ends and dictionaries; A from the tokenizer's own file."""
    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = {c: b for b, c in packing.byte_symbols().items()}
    piece = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    out, links, counts = [], [], Counter()
    for doc_id, text in rows:
        ids_a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b_tok.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in a_tok.id_to_token(i)) for i in ids_a]
        bytes_b = [piece(i) for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a = np.cumsum([0, *map(len, bytes_a)])[1:].tolist()
        ends_b = np.cumsum([0, *map(len, bytes_b)])[1:].tolist()
        common = set(ends_a) & set(ends_b)
        inside = lambda end: bisect_left(sorted_common, end)
        sorted_common = sorted(common)
        sides = [([], []) for _ in common]
        for which, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
            for token, end in zip(ids, ends):
                sides[inside(end)][which].append(str(token))
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in sides]
        last_a, last_b = dict(zip(ends_a, ids_a)), dict(zip(ends_b, ids_b))
        mine = [(last_a[end], last_b[end]) for end in sorted_common]
        counts.update(mine)
        links.append(mine)
        text_groups = ";".join(groups)
        out.append([doc_id, len(ids_a), len(ids_b), len(groups), len(mine), hashlib.sha256(text_groups.encode()).hexdigest() if text_groups else ""])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (*row[:5], sum(counts[p] == best[p[1]] for p in mine), sum(counts[p] for p in mine), row[5]) for row, mine in zip(out, links)]


def scored(docs):
    stored = cut_lineage(alignment.align(docs, RANKS, public_tokenizers.PATTERN, PIECES))
    return alignment.link_scores(stored)


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("hot", [1, 50, 200_000])
def test_alignment_of_hard_texts(hard, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    rows = [
        (r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
        for r in scored(hard).collect()
    ]
    given_rows = [(i % 9 if i else None, text) for i, text in enumerate(HARD * 2)]
    assert sorted(rows, key=key) == sorted(plain(given_rows), key=key)


def test_alignment_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in op12_alignment(spark, folder).collect()]
    assert sorted(rows) == sorted(plain([(d["doc_id"], d["text"]) for d in docs]))


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 300)), st.sets(st.integers(1, 300)), st.integers(301, 310))
def test_cuts(left, right, end):
    a, b = (np.array(sorted(x | {end}), np.int64) for x in (left, right))
    cut_a, cut_b = alignment.cuts(a, b)
    common = np.intersect1d(a, b)
    assert a[cut_a].tolist() == b[cut_b].tolist() == common.tolist()


def test_runs_jump():
    a = np.arange(1, 10_001)
    b = np.delete(a, 5000)
    assert alignment.runs(a, b) == ([0, 5001], [0, 5000], [5000, 4999])


def test_alignment_nothing(empty):
    assert scored(empty).collect() == []
