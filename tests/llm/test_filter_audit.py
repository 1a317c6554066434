"""The filter interaction audit against counting every order document by document."""

from collections import Counter
from itertools import permutations
from math import factorial

import pytest

from instqc.llm import common, filter_audit


def test_ways():
    for n in (1, 3, 5):
        table = filter_audit.ways(n)
        assert len(table) == n * 2 ** (n - 1)
        for state, _, orders in table:
            k = bin(state).count("1")
            assert orders == factorial(k) * factorial(n - k - 1)


def plain(failures, names):
    """Every order walked for every document."""
    out = []
    for part in {r[0] or "" for r in failures}:
        rows = [r for r in failures if (r[0] or "") == part]
        table = {}
        for order in permutations(range(len(names))):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1] >> f & 1]
                fails = sum(r[1] >> f & 1 for r in rows)
                left = [r for r in left if not r[1] >> f & 1]
                table[order, step] = (
                    len(left), len(gone), fails - len(gone), sum(r[1] == 1 << f for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone))
        total = Counter()
        for (order, step), row in table.items():
            total[order[step - 1]] += row[1]
        out += [(part, "".join(names[f] for f in order), step, *row, total[order[step - 1]]) for (order, step), row in table.items()]
    return sorted(out)


@pytest.mark.parametrize("names", ["X", "PQR", "ABCDE"])
def test_audit(spark, names):
    rows = [(("en", "fr", None, "")[i % 4], i * 7 % 2 ** len(names), i % 3 == 0, i % 5 == 0) for i in range(97)]
    df = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean").selectExpr("*", "1 AS removed", "2 AS state")
    assert sorted(map(tuple, filter_audit.audit(df, names).collect())) == plain(rows, names)


def test_failures(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, long, "en"), (2, long, "en"), (3, None, None), (4, "", ""), (5, long + " #", "en"), (6, "A" * 20, "fr"), (6, "again", "fr"), (None, "", "en"),
        (7, "word " * 5000, "en"), (0, "again", "de"),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "2 AS part", "3 AS digest", "4 AS first")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (4, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.document_failures(table, labels).collect()), key=str)
    expected = [
        ("en", 0, True, True), ("en", 16, False, False), (None, 1, False, False), ("", 17, False, True), ("en", 8, False, False), ("fr", 5, False, False),
        ("fr", 17, False, False), ("en", 1, False, False), ("en", 2, False, False), ("de", 1, False, False),
    ]
    assert got == sorted(expected, key=str)


def test_nothing(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.document_failures(empty, labels), "ABCDE").collect() == []
    with pytest.raises(ValueError):
        filter_audit.audit(filter_audit.document_failures(empty, labels), "AAB")


def test_many_labels_and_copies_are_not_broadcast(spark, monkeypatch):
    """Beyond the bound neither the labels nor the digests of copies are joined by broadcast, and the rows stay the same."""
    docs = spark.createDataFrame([(n, f"text {n % 30}", "en") for n in range(90)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(n, n % 2, int(n % 7 == 0)) for n in range(0, 90, 3)], "doc_id long, quality int, toxic int")
    joins = lambda df: df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")
    few = filter_audit.document_failures(docs, labels)
    assert joins(few) == 2
    monkeypatch.setattr(common, "BROADCAST_ROWS", 20)
    # Labels that count: 20 of 30.
    many = filter_audit.document_failures(docs, labels.unionByName(labels.selectExpr("doc_id + 1 AS doc_id", "1 AS quality", "0 AS toxic")))
    assert joins(many) <= 1
    many = filter_audit.document_failures(docs, labels.unionByName(labels.selectExpr("doc_id + 1000 AS doc_id", "1 AS quality", "0 AS toxic")))
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
