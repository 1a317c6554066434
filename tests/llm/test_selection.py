import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from instqc.llm.common import digest
from instqc.llm import decontamination, extraction, licences, mixing, quality, sharding, toxicity


def test_mix_report_and_rows_agree(spark, folder, odd, empty):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    report = mixing.mixing_report(docs).toPandas()
    assert (report.taken <= 2 * report["size"]).all()
    by = report.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert (abs(by.taken - by.target) <= by.largest).all()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = mixed.select(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")))).first()[0]
    assert taken == report.taken.sum()
    assert mixing.mixing_report(odd).count() == odd.count() and mixing.mix(odd).columns == odd.columns
    assert mixing.mixing_report(empty).count() == 0


def test_targets_stop_at_twice_the_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert t["a"] == 20 and t[None] == 0
    assert abs(sum(t.values()) - 1.5 * 1510) < 1e-9 and all(t[s] <= 2 * n for s, n in (("b", 1000), ("c", 500)))


def test_targets_against_resharing_in_rounds(spark):
    rng = random.Random(11)
    sizes = {f"s{i:02d}": rng.choice([0, 5, 100, 1000, 20_000]) + rng.randrange(50) for i in range(23)}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    target, left, open_ = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - 2 * n) for s, n in sizes.items())
        target = {s: min(t, 2 * sizes[s]) for s, t in target.items()}
        open_ = {s for s in open_ if target[s] < 2 * sizes[s]}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert all(abs(got[s] - t) < 1e-6 for s, t in target.items())


def test_hilbert_steps_are_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = sharding.hilbert_index(grid, 3)
    assert sorted(place) == list(range(512))
    walk = grid[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, folder, odd, empty, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    r = sharding.shard_report(docs).toPandas()
    counts = r.shard.value_counts()
    assert len(r) == docs.count() and counts.max() - counts.min() <= 1 and set(counts.index) == set(range(8))
    for _, part in r.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
        assert part.sort_values("slot").curve_index.is_monotonic_increasing
    assert r.groupby("shard").curve_index.max().is_monotonic_increasing
    assert sorted(sharding.shard_report(odd).toPandas().shard.value_counts(), reverse=True)[0] <= 2
    assert sharding.shard_report(empty).count() == 0
    sharding.write_shards(docs, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def _overlap(doc, item):
    a, b = doc.lower().split(), item.lower().split()
    n = len(b)
    stretch, need = (16, 13) if n >= 16 else (n, n - 2 if n >= 12 else n - 1 if n >= 8 else n)
    return any(
        sum(0 <= g + s + k < len(a) and a[g + s + k] == b[s + k] for k in range(stretch)) >= need
        for g in range(-len(b), len(a)) for s in range(len(b) - stretch + 1)
    )


def test_decontamination_against_all_places(spark, odd, empty):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(n) for n in (1, 4, 5, 7, 8, 9, 10, 11, 12, 14, 15, 16, 17, 25, 40)]
    docs = []
    for i in range(80):
        item = list(rng.choice(items))
        for place in rng.sample(range(len(item)), min(len(item), rng.randint(0, 5))):
            item[place] = "other"
        docs.append((i, " ".join(text(rng.randint(0, 20)) + item[rng.randint(0, 3) :] + text(rng.randint(0, 20)))))
    df = spark.createDataFrame([*docs, (None, None), (81, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contamination(df, bench).collect()}
    want = {(d, i) for d, t in docs for i, x in enumerate(items) if _overlap(t, " ".join(x))}
    assert got == want and len(want) > 10
    left = decontamination.drop_contaminated(df, bench)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, i in want if len(items[i]) >= 8} | {None, 81}
    one = spark.createDataFrame([(1, "Two THREE four five six seven eight other ten."), (2, " ")], "item_id long, text string")
    clean = decontamination.drop_contaminated(odd, one)
    assert clean.columns == odd.columns
    assert {tuple(r) for r in clean.collect()} == {tuple(r) for r in odd.collect() if not (r.text or "").startswith("One two")}
    assert decontamination.contamination(empty, bench).count() == 0 and decontamination.contamination(df, bench.limit(0)).count() == 0


def test_licences_of_odd_documents(spark, odd, empty):
    text = "x CC BY cc-by\nAll rights RESERVED. All rights reserved, GNU General Public License\nredistribution and use in source or binary forms, with or without modification, are permitted"
    r = licences.licence_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_base, r.first_word, r.base_labels, r.score) == (5, 1, "cc-by,gpl,reserved", 1.0) and "bsd" in r.labels.split(",")
    assert r.last_word == 12
    assert licences.licence_report(odd).count() == odd.count() and licences.licence_report(empty).count() == 0


NOTICES = {
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0",
    "All of it is licensed under CC-BY-SA\n4.0 and no other.": "cc-by,cc-by-sa-4.0",
    "Released under the MIT License.": "mit",
    "the plan was licensed last year under rules made by the city in 4 parts and 0 costs cc": "",
    "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public\n# License, version 2": "gnu-free,gpl",
    "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software": "mit",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.": "mpl-2.0",
    "granted software person mit": "",
}


def test_licence_notices(spark):
    """Wrapped and short notices get their own label; sister licences and scattered words get none."""
    texts = {f"{'some words before '*n}{text}{' and more behind'*n}": labels for n in (0, 40) for text, labels in NOTICES.items()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {list(texts)[r.doc_id]: r.labels for r in licences.licence_report(df).collect()}
    assert got == texts


def test_licence_blocks_against_all_runs(spark):
    rng = random.Random(6)
    docs = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            notice = rng.choice(licences.TEMPLATES)[1].split()
            words += [w if rng.random() < 0.9 else rng.choice(["x", "cc", "nc", "the"]) for w in notice] + ["y"] * rng.randint(0, 3)
        docs.append((i, rng.choice(" \n").join(words)))

    def found(text):
        a, out = text.split(), {}
        for label, words, must, other in licences.TEMPLATES:
            words, must, other = words.split(), set(must.split()), set(other.split())
            for s in range(max(1, len(a) - len(words) + 1)):
                block = set(a[s : s + len(words)])
                n = len(block & set(words))
                if 10 * n >= 8 * len(set(words)) and must <= block and not other & block:
                    out[label] = max(out.get(label, 0), n / len(set(words)))
        return out

    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_th", digest(F.col("text")))
    got = {}
    for r in licences.contained(df.select("_th", "text")).join(df.drop("text").distinct(), "_th").collect():
        got.setdefault(r.doc_id, {})[r.label] = r.shared
    assert got == {i: f for i, t in docs if (f := found(t))} and len(got) > 60


def test_quality_on_labels(spark, folder, odd, empty):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    r = quality.quality_report(docs).join(labels, "doc_id").toPandas()
    assert (r.kept[r.quality == 1]).mean() > 0.97 and (~r.kept[r.quality == 0]).mean() > 0.75
    assert quality.keep_good(odd).columns == odd.columns
    scored = quality.quality_report(odd).toPandas()
    assert len(scored) == odd.count() and scored.score.between(0, 1).all()
    assert quality.quality_report(empty).count() == 0


def test_label_model_finds_the_bad_labeller():
    rng = random.Random(1)
    patterns = {}
    for _ in range(3000):
        good = rng.random() < 0.8
        votes = "".join("1" if (rng.random() < right) == good else "0" for right in (0.95, 0.9, 0.9, 0.5))
        patterns[votes] = patterns.get(votes, 0) + 1
    model = quality.fit_labels(patterns)
    right = [(model.rates["1"][1, i] + model.rates["0"][0, i]) / 2 for i in range(4)]
    assert min(right[:3]) > 0.8 and abs(right[3] - 0.5) < 0.1


@pytest.fixture(scope="module")
def marked():
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "trmsp" for b in ("ala", "eno", "iru") for c in ("k", "des", "ling")]
    bad = ["vilegrot", "snarkwit", "dregmuck"]
    rows = []
    for i in range(600):
        toxic = i % 5 == 0
        text = [rng.choice(bad) if toxic and rng.random() < 0.05 else rng.choice(words) for _ in range(rng.randint(60, 200))]
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text), int(toxic)))
    return pd.DataFrame(rows, columns=["doc_id", "text", "toxic"])


def test_toxicity_held_out(spark, marked, odd, empty):
    df = spark.createDataFrame(marked)
    r = toxicity.toxicity(df, df).toPandas().merge(marked, on="doc_id")
    held = r[r.held_out]
    assert 100 < len(held) < 200 and (held.predicted == held.toxic).mean() > 0.95 and r.score.between(0, 1).all()
    assert ((r.score >= 0.3).astype(int) == r.predicted).all()
    assert toxicity.toxicity(odd, df).count() == odd.count()
    assert toxicity.toxicity(empty, df).count() == 0 and toxicity.toxicity(df, df.limit(0)).count() == 600


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>x</style></head><body class="page"><header><h1>Site</h1><nav><ul><li><a href="/">Home</a></ul></nav></header>
<div id="cookie-notice">We use cookies <button>OK</button></div><div class="sidebar"><p>Side</p></div><main><article class="post"><header><h1>Title &amp; more</h1></header>
<p>First <b>bold</b>, with a <a href="x>y">link</a>.<p>Second&nbsp;line<br>broken <img src="a.png"> <span class="ad">Buy</span> end</p><ul><li>one<li>two</ul>
<form><input name=q>Subscribe</form><aside>Aside</aside><table><tr><td>c1<td>c2</table><pre>a
  b</pre></article><section class="comments"><p>Nice post!</p></section></main><footer>&copy; me</footer><script>var a="</p>";</script></body></html>"""


def test_marks_of_a_page():
    assert extraction.main_text(extraction.parse(PAGE), set()) == "Title & more First bold, with a link. Second line broken end one two c1 c2 a b"
    assert extraction.main_text(extraction.parse(None), set()) == "" and extraction.main_text(extraction.parse("a < b"), set()) == "a < b"


def test_template_of_a_host(spark):
    """Without telling marks, what the host's pages share goes and their own text stays; other hosts keep theirs."""
    page = "<html><body><div class='q1'><div>Start</div><div>Shop</div></div><div class='q2'><h2>Head {0}</h2><div>Text number {0}.</div></div><div class='q3'>Terms apply</div></body></html>"
    rows = [(i, f"http://one.example.org/{i}", page.format(i)) for i in range(6)] + [(9, "http://two.example.org/", page.format(9)), (10, None, None), (None, "odd", ""), (11, "http://one.example.org/x", None)]
    got = {(r.page_id, r.url): r for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert got[3, "http://one.example.org/3"].text == "Head 3 Text number 3."
    assert got[9, "http://two.example.org/"].text == "Start Shop Head 9 Text number 9. Terms apply"
    assert got[10, None].text == "" and got[10, None].n_chars == 0


def test_copies_keep_their_text(spark):
    """Repeated rows and copies under other urls are no template, with and without an article element, nor do they hide one."""
    plain = "<html><body><div class='q1'><div>Start</div><div>Shop</div></div><div class='q2'><h2>Head {0}</h2><div>Text {0}.</div></div><div class='q3'>Terms</div></body></html>"
    marked = "<html><body><main><h1>Head {0}</h1><p>One {0}.</p><p>Two {0}.</p></main></body></html>"
    rows = [(1, "http://a.example.org/", plain.format(1))] * 4 + [(i, f"http://m.example.org/{i}", marked.format(min(i, 20))) for i in range(18, 60)]
    rows += [(i, f"http://b.example.org/{i}", f"<!-- {i} -->" + plain.format(min(i, 4))) for i in range(30)]
    got = {(r.page_id, r.url): r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1, "http://a.example.org/"] == "Start Shop Head 1 Text 1. Terms"
    assert all(got[i, f"http://m.example.org/{i}"] == "Head {0} One {0}. Two {0}.".format(min(i, 20)) for i in range(18, 60))
    assert all(got[i, f"http://b.example.org/{i}"] == "Head {0} Text {0}.".format(min(i, 4)) for i in range(30))


def test_pages_without_rows(spark):
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shared_passages_stay(spark, folder):
    """A passage that many pages share is no template: pages of the table keep their whole article."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    alone = {r.page_id: extraction.main_text(extraction.parse(r.html), set()) for r in pages.collect()}
    assert {r.page_id: r.text for r in extraction.extract(pages).collect()} == alone


def test_equal_texts_share_a_shard(spark, folder):
    """Of equal texts of one source, language and size only those at a cut between shards are apart."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "text")
    many = docs.unionByName(docs.selectExpr("doc_id + 1000000 AS doc_id", "source", "lang", "text")).unionByName(docs.selectExpr("doc_id + 2000000 AS doc_id", "source", "lang", "text"))
    cut = sharding.shard(many).groupBy("source", "lang", "text").agg(F.count_distinct("shard").alias("n"))
    assert cut.filter("n > 1").count() <= 7 * 3
