import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from instqc.llm import common, exact_dedup, lines, near_dedup
from instqc.llm.components import components


def test_exact_over_several_batches(spark, tmp_path):
    """State survives between batches and calls; short digests clash and are told apart by their bytes."""
    path, rng = str(tmp_path / "d"), random.Random(2)
    data = [(i, rng.choice(["", None, "a", "b", f"text {i % 7}", f"own {i}"])) for i in range(60)] + [(3, "twice"), (3, "twice"), (None, "a"), (None, "only null")]
    for part in range(4):
        spark.createDataFrame(data[part::4], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    got = exact_dedup.dedup(spark, path, digest_bits=4, batch_bytes=1).collect()
    groups = {}
    for i, t in data:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(data)
    want = sorted(
        ((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in data), key=str
    )
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e"))
    assert exact_dedup.dedup(spark, str(tmp_path / "e")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(0, i) for i in range(100, 140)]
    root = {i: i for e in edges for i in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    alone = {i for i in root if all(i not in e or e[0] == e[1] for e in edges)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {i: r for i, r in root.items() if i not in alone}


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300))
@settings(max_examples=30, deadline=None)
def test_signature_draws_on_the_set(items):
    hashes = np.array(sorted(items), np.uint64)
    s = near_dedup.signature(hashes)
    assert len(s) == near_dedup.BINS and set(s.tolist()) <= items
    assert (s == near_dedup.signature(hashes)).all()


def _link_components(docs, k, percent):
    cache, sets, root = near_dedup.WordHashes(), {}, {}
    for n, (i, t) in enumerate(docs):
        sets[n], root[n] = set(near_dedup.shingle_set(t, k, cache).tolist()), n
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
    return sets, root


def test_near_against_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 6)):
            copy = [rng.choice(words) if rng.random() < 0.03 else w for w in base]
            docs.append((len(docs), " ".join(copy).upper() if rng.random() < 0.5 else " ".join(copy)))
    docs += [(None, docs[0][1]), (3, docs[3][1]), (900, ""), (901, None), (None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=2).collect()
    sets, root = _link_components(docs, 2, 80)
    low = {}
    for n, (i, _) in enumerate(docs):
        if i is not None:
            low[root[n]] = min(low.get(root[n], i), i)
    want = sorted(((i, len(sets[n]), low.get(root[n])) for n, (i, _) in enumerate(docs)), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_in_one_large_bucket(spark):
    """Over 64 unlike classes share a bucket: pairs at the threshold are linked also if no centre is like them, and pairs below are not."""
    rng = random.Random(8)
    draw = lambda n: [rng.randrange(-(2**63), 2**63) for _ in range(n)]
    sets, common = [], draw(10)
    for n in range(90):  # boilerplate that all hold
        sets.append(common + draw(20 + n % 7))
    for n in (27, 45, 63):
        both = common + draw(8 * n // 9 - 10)
        sets += [both + draw(n - len(both)) for _ in range(2)]
        sets += [both[1:] + draw(n - len(both) + 1), both[-1:] + draw(n)]
    made = sorted((near_dedup.set_key(np.sort(np.array(s, np.int64))), sorted(s, key=lambda x: x % 2**64)) for s in sets)
    members = spark.createDataFrame([(1, k, len(s)) for k, s in made], "bucket long, key binary, n long")
    got = {bytes(r.node): bytes(r.root) for r in near_dedup.star_components(members, spark.createDataFrame(made, "key binary, items array<long>"), 80).collect()}
    root = {k: k for k, _ in made}
    for a, s in made:
        for b, t in made:
            if a < b and 100 * len({*s} & {*t}) >= 80 * len({*s} | {*t}):
                root = {k: min(root[a], root[b]) if r in (root[a], root[b]) else r for k, r in root.items()}
    assert got == root and len(made) - len(set(root.values())) >= 3


def test_drop_near_keeps_columns(spark, odd, empty):
    left = near_dedup.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    texts = sorted(str(r.text)[:20] for r in left.collect())
    assert texts.count("One two three four f") == 1 and len([t for t in texts if t.startswith("Another")]) == 1
    assert near_dedup.drop_near_duplicates(empty).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abé 日") for _ in range(rng.randint(20, 40))) for _ in range(20)]

    def edited(s):
        s = list(s)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s))
            s[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        return "".join(s)

    docs = [(d, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(0, 5)))) for d in range(50)]
    df = spark.createDataFrame([*docs, (None, base[0]), (5, docs[5][1]), (7, None), (8, " \n")], "doc_id long, text string")
    links, _ = lines.near_lines(df)
    ids = {r.line: r.id for r in lines.line_rows(df).select("line", "id").distinct().collect()}
    long = [x for x in ids if len(x) >= lines.LEAST_CHARS]
    want = {frozenset((ids[a], ids[b])) for n, a in enumerate(long) for b in long[:n] if _distance(a, b) <= lines.EDITS}
    assert {frozenset((r.a, r.b)) for r in links.collect()} == want
    report = lines.line_report(df).collect()
    assert len(report) == len(docs) + 4
    assert all(r.n_lines == r.n_kept + r.n_copies + r.n_near for r in report)
    assert len({(r.n_lines, r.n_kept, r.n_links) for r in report if r.doc_id == 5}) == 1


def test_lines_of_odd_documents(spark, odd, empty):
    assert lines.line_report(odd).count() == odd.count()
    assert lines.line_report(empty).count() == 0


@given(st.sets(st.integers(0, 2**64 - 1), max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=80))
@settings(max_examples=30, deadline=None)
def test_parity_bits_never_differ_more_than_sets(a, b):
    one, two = (near_dedup.parity(np.array(sorted(s), np.uint64)) for s in (a, b))
    assert len(one) == near_dedup.PARITY_WORDS and sum(int(x).bit_count() for x in one ^ two) <= len(a ^ b)


def test_near_shares_of_a_set_are_not_compared_in_full(spark, monkeypatch):
    """Classes that share half of their items meet in a bucket: full sets are read for the pairs that may fit, not for each."""
    rng = random.Random(9)
    draw = lambda n: [rng.randrange(-(2**63), 2**63) for _ in range(n)]
    common, sets = draw(60), []
    for _ in range(60):
        own = draw(60)
        sets.append(common + own)
    sets.append(sets[0][3:] + draw(3))
    made = sorted((near_dedup.set_key(np.sort(np.array(s, np.int64))), s) for s in sets)
    members = spark.createDataFrame([(1, k, len(s)) for k, s in made], "bucket long, key binary, n long")
    seen, whole = [], near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, *rest: seen.append(pairs.count()) or whole(pairs, *rest))
    got = near_dedup.star_components(members, spark.createDataFrame(made, "key binary, items array<long>"), 80).collect()
    assert len(got) == 61 and len({bytes(r.root) for r in got}) == 60 and 1 <= sum(seen) < 10


def test_lines_with_a_common_third_are_not_paired(spark):
    """Variants of a line that share a segment and no more are told apart where they meet; those within two edits are linked."""
    rng = random.Random(10)
    lines_ = ["a common beginning of it " + "".join(rng.choice("etaonihr slcd") for _ in range(50)) for _ in range(120)]
    lines_ += [lines_[0][:60] + "#" + lines_[0][61:], lines_[1][:40] + lines_[1][42:], lines_[2][:30] + "xx" + lines_[2][30:]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines_)], "doc_id long, text string")
    distinct = lines.line_rows(df).select("line", "id").distinct()
    assert lines.candidate_pairs(distinct, 2).count() < 900
    ids = {r.line: r.id for r in distinct.collect()}
    want = {frozenset((ids[lines_[i]], ids[lines_[120 + i]])) for i in range(3)}
    assert {frozenset((r.a, r.b)) for r in lines.near_lines(df)[0].collect()} == want


def _links(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r.line: r.id for r in lines.line_rows(df).select("line", "id").distinct().collect()}
    held = list(ids)
    want = {frozenset((ids[a], ids[b])) for n, a in enumerate(held) for b in held[:n] if abs(len(a) - len(b)) <= lines.EDITS and _distance(a, b) <= lines.EDITS}
    return df, want, {frozenset((r.a, r.b)) for r in lines.near_lines(df)[0].collect()}


def test_lines_of_a_crowd_meet_by_finer_keys(spark):
    """Lines alike but for two words made of the same letters: few pairs are left, where each line met each other one."""
    rng = random.Random(11)
    word = lambda: "".join(rng.sample("etaonihr", 8))
    texts = [f"here stands the same line again and {word()} so far {word()} to its end" for _ in range(100)]
    texts += [texts[0].replace("again", "agan"), texts[1][:-1] + "!", texts[2][:30] + "x" + texts[2][30:50] + texts[2][51:]]
    df, want, got = _links(spark, texts)
    assert len(want) == 3 and got == want
    assert lines.candidate_pairs(lines.line_rows(df).select("line", "id").distinct(), 2).count() < 1000


@pytest.mark.parametrize("crowd", [1, 6])
def test_crowds_lose_no_link(spark, monkeypatch, crowd):
    """Moved, repeated and missing letters in lines of two letters, all of them in crowds, against all pairs."""
    monkeypatch.setattr(lines, "CROWD", crowd)
    rng = random.Random(12)
    base = ["".join(rng.choice("ab") for _ in range(n)) for n in (26, 27, 31)]

    def edited(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s))
            s[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "ba"])
        return "".join(s)

    _, want, got = _links(spark, [x for x in (edited(rng.choice(base)) for _ in range(150)) if len(x) >= lines.LEAST_CHARS])
    assert len(want) > 300 and got == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_lines_are_not_broadcast(spark, tmp_path):
    """A small file of lines, as Spark sees it, makes very many keys; joined by broadcast they would all go through the driver."""
    spark.range(500).selectExpr("concat('some line of ordinary words ', id) AS line", "id", "char_length(concat('some line of ordinary words ', id)) AS size").write.parquet(f"{tmp_path}/held")
    held = spark.read.parquet(f"{tmp_path}/held")
    index = lines.finer_keys(held, 6, 2, False).selectExpr("key", "id AS b")
    probe = lines.finer_keys(held, 6, 2, True).selectExpr("key", "id AS a")
    for crowd in (None, 32):
        assert "BroadcastHashJoin" not in plan_of(lines.meetings(probe, index, probe["a"] > index["b"], crowd))
    rows = held.select("line", "id")
    assert "BroadcastHashJoin" not in plan_of(lines.first_meetings(rows, 2))


def test_many_keys_are_not_broadcast(spark, monkeypatch):
    """Beyond the bound keys go by shuffle, however small their file is; only rows with a marked hash are shuffled, and all rows that count come out."""
    big = spark.range(20_000).selectExpr("id AS n", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 5000 END AS k", "cast(id % 3 AS string) AS j")
    keys = spark.range(0, 4000, 4).selectExpr("id AS k", "cast(id % 3 AS string) AS j").unionByName(spark.range(40).selectExpr("id AS k", "'1' AS j"))
    expected = big.join(keys, ["k", "j"], "left_semi").collect()
    assert 0 < len(expected) < 4000
    monkeypatch.setattr(common, "BROADCAST_ROWS", 50)
    got = common.only_keys(big, keys, ["k", "j"])
    plan = plan_of(got)
    assert got.columns == big.columns and sorted(map(tuple, got.collect())) == sorted((r["n"], r["k"], r["j"]) for r in expected)
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") == 1 and plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")
    assert common.maybe_in(big, keys, ["k", "j"]).count() < 1.1 * len(expected)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5000)
    assert "SortMergeJoin" not in plan_of(common.only_keys(big, keys, ["k", "j"]))


def test_lines_beyond_the_bound(spark, monkeypatch):
    """With every table beyond the bound, lines get what they get by broadcast."""
    rng = random.Random(5)
    base = ["".join(rng.choice("etaonihrs dlu") for _ in range(40)) for _ in range(30)]
    texts = ["\n".join(line[:i] + "xy"[: (n + i) % 3] + line[i + 1 :] for i, line in enumerate(base)) for n in range(9)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)] + [(3, texts[4]), (None, texts[0]), (40, None)], "doc_id long, text string")
    read = lambda: sorted(map(tuple, lines.line_report(docs).collect()), key=str)
    expected = read()
    assert sum(r[-1] for r in expected) > 0
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert read() == expected
