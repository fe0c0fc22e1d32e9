"""Decontamination, licences, URL rules, top-k and chat formatting: brute force and the defined results of odd inputs."""

import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, decontaminate, licences, notices, queries, topk, urls
from graphloom.llm.common import fold


FOLDER = "/root/testdata/sf0.01"


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if w]


def hits(text, items, n):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        size = min(n, len(v))
        for i in range(len(v) - size + 1 if v else 0):
            for at in range(len(w) - size + 1):
                if w[at : at + size] == v[i : i + size]:
                    hit.update(range(at, at + size))
                    found.add(item)
    return len(w), sorted(hit), sorted(str(f) for f in found if f is not None)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 40 + ["É", "x1"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((3, 9, 10, 11, 25))))) for k in range(12)] + [(3, "dup item, same id"), (None, "no id words"), (77, None), (78, "?!"), (79, "the the the the")]
    docs = []
    for k in range(60):
        text = rng.choices(vocabulary, k=rng.randrange(0, 80))
        if k % 3 == 0:
            part = words(items[rng.randrange(12)][1])
            text[rng.randrange(len(text) + 1) :] = part[rng.randrange(2) :] + text[-3:]
        docs.append((k, ", ".join(t.title() if k % 2 else t for t in text)))
    docs += [(60, None), (61, ""), (5, docs[5][1]), (None, docs[9][1]), (62, "the " * 3000), (5, "another text under id five no id words")]
    return docs, items


def test_decontamination(spark, corpus):
    docs, items = corpus
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("start", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(table, bench, 10)
    got = sorted(((r["doc_id"], r["text"], r["__found"]["n_words"], sorted({p for h in r["__found"]["hits"] for p in range(h["start"], h["start"] + h["length"])}), sorted({i for h in r["__found"]["hits"] for i in h["items"]})) for r in found.collect()), key=str)
    assert got == sorted(((i, t, *hits(t, items, 10)) for i, t in docs), key=str)
    kept = decontaminate.clean(table, bench, 10)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] or -1 for r in kept.collect())) == sorted(i or -1 for i, t in docs if not hits(t, items, 10)[1])


def test_decontamination_of_nothing(spark, corpus):
    docs, items = (spark.createDataFrame(rows, schema) for rows, schema in zip(corpus, ("doc_id long, text string", "item_id long, text string"), strict=True))
    assert decontaminate.find(docs.limit(0), items).collect() == []
    assert decontaminate.find(docs, items.limit(0)).where(F.size("__found.hits") > 0).count() == 0


def test_occurrences_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 13)
    rng = random.Random(8)
    items = [(k, " ".join(rng.choices("abcdef", k=rng.choice((2, 5, 12, 14))))) for k in range(15)]
    docs = [(k, " ".join(rng.choices("abcdef", k=rng.randrange(60))) + " " + items[k % 15][1] * (k % 3)) for k in range(40)]
    found = decontaminate.counts(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    want = {i: (len(words(t)), len(hits(t, items, 5)[1]), hits(t, items, 5)[2]) for i, t in docs}
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found.collect()} == want


def test_a_long_text_of_passages(spark):
    """Hundreds of thousands of places in one document; no row holds them all, and time follows their number."""
    item = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, (item + " x ") * 20_000), (2, "w1 w2")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.counts(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert found == {1: (20_000 * 26, 20_000 * 25, ["9"]), 2: (2, 0, [])}


def near_by(text, items, within):
    """(item, position) of proximity matches, by looking at every word."""
    own, found = words(text), set()
    for i, item in items:
        terms = sorted(set(words(item)))
        for at in range(len(own)):
            if terms and own[at] in terms and all(t in own[max(0, at - within) : at + within + 1] for t in terms):
                found.add((i, at, own[at]))
    return found


def test_proximity_like_a_window(spark):
    rng = random.Random(3)
    items = [(k, " ".join(rng.sample("abcdefgh", k=rng.choice((1, 2, 3))))) for k in range(8)]
    docs = [(k, " ".join(rng.choices("abcdefghxyz", k=rng.randrange(50)))) for k in range(30)]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    counts = {t: sum(words(d).count(t) for _, d in docs) for t in "abcdefgh"}
    for within in (1, 4):
        found = {(r["doc_id"], r["item_id"], r["pos"]) for r in decontaminate.near(*tables, within).collect()}
        every = {(d, i, at, t) for d, text in docs for i, at, t in near_by(text, items, within)}
        # those at occurrences of an item's rarest term; which of equally rare ones is the operator's choice
        rarest = {i: min(counts[t] for t in words(item)) for i, item in items}
        assert found <= {(d, i, at) for d, i, at, t in every if counts[t] == rarest[i]}
        assert {(d, i) for d, i, _ in found} == {(d, i) for d, i, at, t in every if counts[t] == rarest[i]} or any(sum(counts[t] == rarest[i] for t in words(item)) > 1 for i, item in items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x blue"), (2, "red x y z blue"), (3, None), (4, "blue red red")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "Red, blue!"), (8, "green"), (9, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.near(docs, items, 2).collect()}
    assert found == {(1, 7), (4, 7)}


#: Wordings that the classifier is not trained on, with the families they name.
UNSEEN = [
    ("MIT", "Use of all source files is subject to the MIT License."), ("MIT", "all files in this folder are MIT"), ("MIT", "Code is provided pursuant to the terms in the MIT licence, 2022"),
    ("Apache-2.0", "Apache License Version 2.0"), ("Apache-2.0", "Apache Licence v2.0 holds for every file"), ("Apache-2.0", "The contents are offered under Apache 2.0, as is"), ("Apache-2.0", "We chose the Apache License for this tool: Apache-2.0."),
    ("GPL", "GNU GPL version 3 governs use of this work"), ("GPL", "Licensed under GPL version 2"), ("GPL", "Anyone may redistribute this under the GNU General Public License"), ("GPL", "The kernel module is GPLv2 only."), ("GPL", "All code is subject to the GPL."),
    ("LGPL", "The library is under the LGPL"), ("LGPL", "Linking is allowed by the GNU Lesser General Public License 3"), ("LGPL", "LGPLv3 covers the library"),
    ("AGPL", "AGPL version 3 governs the server"), ("AGPL", "Server code: GNU Affero General Public License"), ("AGPL", "The service is offered as AGPL-3.0 software"),
    ("BSD", "three-clause BSD"), ("BSD", "Code in this repository: BSD 2-clause"), ("BSD", "Use is governed by the BSD license in the root folder"), ("BSD", "This port is BSD-2-Clause."),
    ("MPL", "use is governed by the Mozilla Public License"), ("MPL", "Files under MPL 2.0 stay under MPL 2.0"), ("MPL", "Our fork keeps the Mozilla Public License 2.0."),
    ("CC-BY", "All photos: CC BY 4.0"), ("CC-BY", "The maps may be used under Creative Commons Attribution 4.0"), ("CC-BY-SA", "Text on this wiki is offered under CC BY-SA 4.0"), ("CC-BY-SA", "This image is offered under Creative Commons Attribution-ShareAlike"),
    ("CC-BY-NC", "Slides are shared under CC BY-NC 4.0"), ("CC-BY-NC", "Teaching material under Creative Commons Attribution-NonCommercial"), ("CC0", "Everything we publish is CC0."), ("CC0", "The data set is released as CC0 1.0"),
    ("proprietary", "Copyright (c) 2024 Acme. All rights reserved."), ("proprietary", "Acme Corp 1998-2003 - all rights reserved"), ("proprietary", "No part may be reproduced without permission"), ("proprietary", "© Roe & Sons. All Rights Reserved"),
]
#: Sentences of other words than the trained ones that are no notices.
OTHERS = ["the Apache tribe lived there", "she reserved all rooms", "general public opinion", "Copyright is a difficult field of law", "Mozilla released version 2.0 of the browser", "the file is 3 MB", "Creative people have things in common", "My licence to fish has expired", "He studied at MIT for years", "Die Lizenz kostet viel Geld", "the right to be reserved about all of it", "free software is a matter of liberty", "A new clause was added to the contract", "cc: all members by Friday", "Attribution of the painting is unclear", "the source was found under the hill", "The park is open to the general public", "commercial and non-commercial boats", "mit dem Zug und mit dem Rad", "version 3 or later will do"]


#: Notices of licences that no family has and training and calibration do not know, and lines with words of notices.
FOREIGN = ["Licensed under the ISC License.", "Released under the EUPL v1.2", "This project is licensed under the WTFPL.", "zlib licence applies", "Distributed under the Artistic License 2.0.", "This is released under the Unlicense.", "License: ISC", "SPDX-License-Identifier: EUPL-1.2", "The code is available under the zlib license.", "Perl parts are covered by the Artistic License.", "Distributed under the Boost Software License", "licensed under Eclipse Public License v2"]
SPOKEN = ["Our BSD servers are down.", "CC by the sea", "The general public license office opened"]


def test_licences_in_other_words(spark):
    taught = {text for _, text in notices.examples()} | set(notices.mentions())
    assert not taught & {text for _, text in UNSEEN} and not taught & set(OTHERS)
    prose = [(1000 + k, f"thon her {k} eating.\nAnd of the {k} thint, sur la table mit der {k} ench.") for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(UNSEEN)] + [(500 + k, t) for k, t in enumerate(OTHERS)] + prose, "doc_id long, text string")
    # trained on other documents than those that are scanned
    model = licences.train(docs.where("doc_id >= 1000"))
    found = {r["doc_id"]: r["family"] for r in licences.scan(docs, model, ["doc_id"]).collect()}
    right = sum(found.get(k) == family for k, (family, _) in enumerate(UNSEEN))
    wrong = [k for k in found if k >= 500]
    print(f"recall {right / len(UNSEEN):.3f}, precision {right / len(found):.3f}", [t for k, (f, t) in enumerate(UNSEEN) if found.get(k) != f], wrong)
    assert right >= 0.9 * len(UNSEEN) and right >= 0.9 * len(found) and not wrong
    strange = spark.createDataFrame([(k, t) for k, t in enumerate([*FOREIGN, *SPOKEN])], "doc_id long, text string")
    taken = [r["doc_id"] for r in licences.scan(strange, model, ["doc_id"]).collect()]
    print("taken for a family:", taken)
    assert len(taken) <= 0.1 * (len(FOREIGN) + len(SPOKEN))
    assert not {t for _, t in notices.examples()} & {*FOREIGN, *SPOKEN} and not {*notices.others(), *notices.calibration()} & {*FOREIGN, *SPOKEN}
    assert model.cut >= licences.LEAST_CUT and licences.FLOORS[0] <= model.floor <= licences.FLOORS[1]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")
def test_planted_licences(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(licences.paragraphs(F.col("text"))).alias("paragraph", "line"))
    true = lines.where(F.col("line").rlike(r"^(All rights reserved\.|(Licensed|Released|This work is licensed) under .*)$")).select("doc_id", F.col("paragraph").cast("long").alias("paragraph"))
    want, got = {tuple(r) for r in true.collect()}, {(r["doc_id"], r["paragraph"]) for r in queries.op8_licence_scan(spark, FOLDER).collect()}
    assert len(want) > 20 and len(want & got) >= 0.98 * len(want) and len(want & got) >= 0.98 * len(got)


def test_licences(spark):
    prose = [(k, f"thon her {k} eating.\nAnd of the {k} thint, sur la table.\n\nno notice here {k}") for k in range(60)]
    noted = [(100, "first\nLicensed under the Apache License, Version 2.0.\nend"), (101, "Released under the MIT License."), (102, "a\r\nThis work is licensed under the GNU General Public License, version 3."), (103, "Licensed under CC BY-NC 4.0."), (None, "x\n\nReleased under the BSD 3-Clause License.")]
    wrapped = [(110, "one line\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."), (111, "It may be used under the Creative Commons\nAttribution-ShareAlike 4.0 licence."), (112, "Text here.\nAll rights\nreserved.")]
    odd = [(200, None), (201, ""), (202, "\n\n \n"), (203, "she licensed the car and left"), (204, "word " * 50000), (205, "line\n" * 20000), (101, "Released under the MIT License.")]
    docs = spark.createDataFrame(prose + noted + wrapped + odd, "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("paragraph", F.lit("y"))
    found = [(r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(docs, licences.train(docs), ["doc_id"]).collect()]
    assert sorted((r for r in found if not 110 <= (r[0] or 0) <= 112), key=str) == sorted([(100, 1, "Apache-2.0"), (101, 0, "MIT"), (101, 0, "MIT"), (102, 1, "GPL"), (103, 0, "CC-BY-NC"), (None, 1, "BSD")], key=str)
    assert {r[2] for r in found if r[0] == 110} == {"GPL"} and {r[2] for r in found if r[0] == 111} == {"CC-BY-SA"} and [r for r in found if r[0] == 112] == [(112, 1, "proprietary")]
    assert licences.scan(docs.limit(0), licences.train(docs.limit(0)), ["doc_id"]).collect() == []


def test_licences_learn_from_all_documents(spark, monkeypatch):
    staged, keep = [], licences.stage
    monkeypatch.setattr(licences, "stage", lambda df: staged.append(keep(df)) or staged[-1])
    licences.train(spark.range(9000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("row"), "id", F.lit("only\nnothing here")).alias("text")))
    assert staged[0].where("array_contains(words, 'row')").count() == 9000


def test_texts_without_a_key_are_no_notices(spark, monkeypatch):
    rng = random.Random(5)
    shown = [text for family in notices.TEMPLATES.values() for text in family]
    near = [" ".join(rng.choice([" ", "\n", "--"]).join(w for w in text.split() if rng.random() < 0.7) for text in rng.sample(shown, rng.choice([1, 1, 2]))) + rng.choice(["", " under", " file", " xyz"]) for _ in range(1500)]
    texts = spark.createDataFrame([(k, t) for k, t in enumerate([*near, *shown, *[t for _, t in UNSEEN], *OTHERS, *FOREIGN, *SPOKEN])], "doc_id long, text string")
    known = licences.templates(spark)
    best = F.greatest(*[licences.similarity(F.lit(f), licences.tokens(F.col("text")), known) for f in notices.FAMILIES])
    told = texts.select(licences.keyed(F.col("text")).alias("keyed"), best.alias("best")).collect()
    assert all(r["keyed"] for r in told if r["best"] >= licences.CONFIRM) and sum(not r["keyed"] for r in told) > 20
    model = licences.train(texts.where("doc_id % 2 = 0"))
    found = lambda docs: {tuple(r) for r in licences.scan(docs, model, ["doc_id"]).select("doc_id", "paragraph", "family").collect()}
    quick, staged = found(texts), found(licences.near(texts))
    monkeypatch.setattr(licences, "keyed", lambda text, confirm=0: text.isNotNull())
    assert quick == staged == found(texts) and len(quick) > 100


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]


def test_url_rules(spark):
    cases = [
        ("http://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"), ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://badexample.com/en/2", "badexample.com", "/en/2", "com/", "allow"), ("http://b.com", "b.com", "", None, "allow"), ("http://net/es/q", "net", "/es/q", "net/es/", "block"),
        ("//no-scheme.net/es/", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://x.net/fr?y://z.com/", "x.net", "/fr", None, "allow"), ("", "", "", None, "allow"), ("x://ÀB.com/é\nq", "Àb.com", "/é\nq", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)] * 2, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("tokens", F.lit(2))
    none = spark.createDataFrame([], urls.RULE)
    got = [tuple(r)[:5] for r in urls.judge(pages, RULES, none, [F.col("page_id")]).collect()]
    assert sorted(got, key=str) == sorted([(k, *c[1:]) for k, c in enumerate(cases)] * 2, key=str)
    assert urls.judge(pages.limit(0), RULES, none, [F.col("page_id")]).collect() == []


def test_url_mining(spark):
    rows = [(f"http://spam-{k % 3}.site{k}.org/en", "block") for k in range(40)] + [(f"http://fine{k}.org/en", "allow" if k % 2 else None) for k in range(60)] + [(None, None)]
    pages = spark.createDataFrame(rows, "url string, label string")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    mined = urls.mine(pages.where("url is not null").select("url", urls.tokens_of(host, path).alias("tokens"), "label"), 0.05, 0.9)
    assert {(tuple(r["tokens"]), r["verdict"]) for r in mined.collect()} >= {(("word:spam",), "block")}
    assert mined.where("key is null").count() == 0
    fresh = spark.createDataFrame([(1, "https://m.spam-9.other.org/en"), (2, "https://other.org/en"), (3, None)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(fresh, RULES, mined, [F.col("page_id")]).collect()} == {1: "block", 2: "allow", 3: "allow"}
    assert urls.mine(pages.where("url is null").select("url", urls.tokens_of(host, path).alias("tokens"), "label"), 0.05, 0.9).collect() == []


def lower_bound(share, n, z=3.0):
    return (share + z * z / (2 * n) - z * ((share * (1 - share) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)


def brute_rules(rows, least, confidence, most=3):
    """All rules of at most three tokens that beat their verdict's share of all rows, without those for which fewer tokens do
    as well: lower bound, support, confidence."""
    share = {v: sum(label == v for _, label in rows) / len(rows) for v in {label for _, label in rows}}
    found = {}
    for tokens in {c for t, _ in rows for n in range(1, most + 1) for c in itertools.combinations(sorted(t), n)}:
        holding = [label for t, label in rows if set(tokens) <= set(t)]
        for verdict in {x for x in holding if x}:
            if holding.count(verdict) >= least and holding.count(verdict) >= confidence * len(holding):
                sure = lower_bound(holding.count(verdict) / len(holding), len(holding))
                if sure > share[verdict]:
                    found[tokens, verdict] = sure, holding.count(verdict) / len(rows), holding.count(verdict) / len(holding)
    fewer = lambda t: (c for n in range(1, len(t)) for c in itertools.combinations(t, n))
    return {(t, v): x for (t, v), x in found.items() if not any(found.get((c, v), (0, 0, 0))[2] >= x[2] for c in fewer(t))}


def test_mining_and_judging_like_all_subsets(spark):
    rng = random.Random(5)
    hosts, paths = ["a", "b", "c-d", "e-f", "www", "org", "net"], ["en", "fr", "x", ""]
    urls_ = sorted({f"http://{'.'.join(rng.sample(hosts, rng.randrange(2, 4)))}/{rng.choice(paths)}/{rng.randrange(9)}" for _ in range(260)})
    label = lambda u: None if rng.random() < 0.2 else "block" if ("c-d" in u and "fr" in u) or ("e-f" in u and rng.random() < 0.9) else "allow"
    labels = [label(u) for u in urls_]
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    table = spark.createDataFrame(list(zip(urls_, labels, strict=True)) * 2, "url string, label string").select("url", "label", urls.tokens_of(host, path).alias("tokens"))
    tokens = {r["url"]: r["tokens"] for r in table.collect()}
    mined = urls.mine(table, 0.02, 0.8, least_urls=4)
    want = brute_rules([(tokens[u], x) for u, x in zip(urls_, labels, strict=True)], max(4, int(0.02 * len(urls_))), 0.8)
    got = {(tuple(r["tokens"]), r["verdict"]): (r["sure"], r["support"], r["confidence"]) for r in mined.collect()}
    base = {v: labels.count(v) / len(labels) for v in ("allow", "block")}
    assert all(abs(r["lift"] - r["confidence"] / base[r["verdict"]]) < 1e-9 and r["lift"] > 1 for r in mined.collect())
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert any(v == "block" and len(t) > 1 for t, v in want)
    pages = spark.createDataFrame(list(enumerate([*urls_, "http://new.e-f/fr/1", None])), "page_id long, url string")
    spelled = {r["page_id"]: r["tokens"] for r in pages.select("page_id", urls.tokens_of(host, path).alias("tokens")).collect()}
    for r in urls.judge(pages, [], mined, [F.col("page_id")]).collect():
        fits = [(*want[t, v][:2], t, v) for t, v in want if set(t) <= set(spelled[r["page_id"]])]
        assert (r["verdict"], r["mined"]) == ((max(fits)[3], " + ".join(max(fits)[2])) if fits else ("allow", None))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the generated tables")
def test_mined_rules_on_held_out_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    held = pages.where(fold(F.col("url"), 4) == 0)
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    # by content and block list, as in the query: content does not depend on URLs in these tables, so only listed words make
    # rules, and no rule may do worse than always saying "allow"
    mined = urls.mine(queries.url_labels(pages), 0.001, 0.85, least_urls=5)
    seeded = F.arrays_overlap(F.split(host, r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, queries.URL_SEEDS)))
    judged = urls.judge(held, [], mined, [F.col("page_id"), F.when(seeded, "block").otherwise(F.coalesce(urls.page_label(F.col("html")), F.lit("allow"))).alias("label")]).collect()
    right, always = (sum(verdict(r) == r["label"] for r in judged) / len(judged) for verdict in (lambda r: r["verdict"], lambda r: "allow"))
    blocked = [r for r in judged if r["verdict"] == "block"]
    print(f"right {right:.3f}, always allow {always:.3f}, blocked {len(blocked)}, rules {mined.count()}")
    assert right >= always and all(r["label"] == "block" for r in blocked)
    # by the verdicts of explicit rules on the learning part: the rules find these verdicts again on the other part
    verdict = urls.rule_of(host, path, queries.URL_RULES)["verdict"]
    mined = urls.mine(pages.where(fold(F.col("url"), 4) != 0).select("url", urls.tokens_of(host, path).alias("tokens"), verdict.alias("label")), 0.001, 0.9, least_urls=5)
    again = urls.judge(held.where(verdict.isNotNull()), [], mined, [F.col("page_id"), verdict.alias("label")], default="none").collect()
    blocked, true = [r for r in again if r["verdict"] == "block"], [r for r in again if r["label"] == "block"]
    hits = sum(r["label"] == "block" for r in blocked)
    print(f"explicit rules found again: precision {hits / len(blocked):.3f}, recall {hits / len(true):.3f}")
    assert hits >= 0.95 * len(blocked) and hits >= 0.9 * len(true)


def test_rules_beat_the_base_rate_on_unseen_hosts(spark):
    """Labels that depend on words and paths, with noise: always saying "allow" is right on three quarters of the pages."""
    rng = random.Random(9)

    def page(k):
        name = "-".join(rng.sample(["shop", "news", "loans", "travel", "prize", "garden"], 2))
        path = rng.choice(["en", "fr", "win", "blog"])
        bad = "prize" in name or ("loans" in name and path == "win")
        return f"http://{name}.{'h' if k < 3000 else 'unseen'}{k}.org/{path}", "block" if (bad if rng.random() < 0.97 else rng.random() < 0.3) else "allow"

    rows = [page(k) for k in range(4000)]
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, label string")
    mined = urls.mine(table.where("page_id < 3000").select("url", urls.tokens_of(host, path).alias("tokens"), "label"), 0.005, 0.85, least_urls=5)
    judged = urls.judge(table.where("page_id >= 3000"), [], mined, [F.col("page_id"), F.col("label")]).collect()
    right, always = sum(r["verdict"] == r["label"] for r in judged) / len(judged), sum(r["label"] == "allow" for r in judged) / len(judged)
    blocked, true = [r for r in judged if r["verdict"] == "block"], [r for r in judged if r["label"] == "block"]
    hit = sum(r["label"] == "block" for r in blocked)
    print(f"right {right:.3f}, always allow {always:.3f}, block precision {hit / len(blocked):.3f}, recall {hit / len(true):.3f}")
    assert right > always + 0.15 and hit > 0.9 * len(blocked) and hit > 0.9 * len(true)
    assert not [r for r in mined.collect() if set(r["tokens"]) <= {"host:org", "path:en", "path:fr", "word:news"} and r["verdict"] == "block"]


def test_urls_are_mined_whole(spark):
    k = F.col("id")
    pages = spark.range(1_050_000).select(
        F.concat(F.lit("http://h"), k, F.lit(".org/")).alias("url"), F.array(F.when(k < 3000, F.lit("word:x")).otherwise(F.lit("word:y"))).alias("tokens"), F.when(k < 2999, F.lit("block")).alias("label")
    )
    assert [(r["tokens"], r["verdict"], r["confidence"]) for r in urls.mine(pages, 0.0002, 0.9).collect()] == [(["word:x"], "block", 2999 / 3000)]


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), [float(x) for x in rng.normal(0, 0.2, 12)]) for k in range(300)]
    rows += [(400 + k, rows[7][1]) for k in range(30)] + [(7, rows[7][1]), (501, None), (502, []), (503, [0.1, None]), (504, [float("nan")] * 12), (505, [float("inf")] * 12), (550, [1.0, 2.0]), (551, [0.5, 0.5]), (None, rows[3][1])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)), F.col("vec_id") % 50 == 0, 5, block=64)
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True), 5).collect() == []


def test_blocks_are_bounded_in_components():
    import tracemalloc

    assert topk.blocks_for(2000, 2000 * 64, 8) == 1 and topk.blocks_for(100_000, 100_000 * 64, 8) == 8
    assert topk.blocks_for(100_000, 100_000 * 1536, 8) == -(-100_000 * 1536 // topk.BLOCK_CELLS) and topk.blocks_for(0, 0, 8) == 1
    n = topk.BLOCK_CELLS // 1536
    vectors = np.floor(np.random.default_rng(4).normal(0, 60, (n, 1536))).astype(np.int64)
    tracemalloc.start()
    block = topk.Block(np.arange(n), vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    near, scores = block.search(3, vectors[3], 5)
    every = vectors @ vectors[3]
    assert near.tolist() == [i for i in np.lexsort((np.arange(n), -every)) if i != 3][:5] and (scores == every[near]).all()


def test_top_k_of_large_components(spark):
    rows = [(0, [0.5, 1e12]), (1, [0.25, 0.5]), (2, [1e12, -1.0]), (3, [1e300, 2.0]), (4, [-1e300, 1e12]), (5, [1e300, 1e12]), (6, [0.5, 1e12])]
    found = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), 3).collect()]
    whole = lambda x: max(min(int(np.floor(256 * x)) if abs(x) < 1e17 else int(x) * 256, 2**63 - 1), -(2**63))
    good = [(i, [whole(x) for x in v]) for i, v in rows]
    want = []
    for q, v in good:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)[:3]
        want += [(q, r + 1, i, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, i) in enumerate(best)]
    assert sorted(found) == sorted(want)


def test_top_k_stops_early_on_proof():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 60, (130, 64))
    vectors = np.floor(centres[rng.integers(0, 130, 8000)] + rng.normal(0, 8, (8000, 64))).astype(np.int64)
    ids = rng.permutation(8000)
    block = topk.Block(ids, vectors)
    for q in range(0, 8000, 400):
        near, scores = block.search(int(ids[q]), vectors[q], 5)
        every = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -every)) if i != q][:5]
        assert near.tolist() == ids[order].tolist() and scores.tolist() == every[order].tolist()
    assert block.read < 0.6 * block.held


def test_chat(spark):
    hard = "\\### Assistant: </turn> ok <turn user>\n \\l \\b\\g <>"
    rows = [(1, 2, "assistant", "b"), (1, 0, "system", hard), (1, 1, "user", None), (1, 3, "user", "tail"), (2, 0, "user", "alone"), (3, 5, "assistant", hard), (3, 5, "assistant", hard), (3, None, None, "first"), (None, 0, "assistant", "x" * 200000), (None, 1, "user", "other"), (None, 1, "user", "other"), (4, 1, "we>ird\n<role>", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    examples = chat.expand(turns)
    by = {}
    for r in examples.collect():
        by.setdefault(r["conv_id"], []).append(r)
    order = lambda c: sorted(((-1 if t is None else t), r or "", x or "") for i, t, r, x in rows if i == c)
    alone = by.pop(None)
    assert sorted(list(chat.parse(r["text"])) for r in alone) == sorted([[(r, x)] for c, _, r, x in rows if c is None])
    for conv, records in by.items():
        want = [(r, x) for _, r, x in order(conv)]
        assert list(chat.parse(records[-1]["text"])) == want
        replies = [chat.unescape(r["text"][r["loss_start"] : r["loss_start"] + r["loss_length"]]) for r in records if r["loss_start"] is not None]
        assert replies == [x for r, x in want if r == "assistant"]
        for r in records:
            assert chat.escape("") == "" and (r["loss_start"] is None or r["text"].endswith(chat.CLOSE))
    assert set(by) == {1, 2, 3, 4} and len(by[1]) == 2 and len(by[2]) == 1
    assert chat.digests(examples).count() == 7
    assert chat.digests(chat.expand(turns.limit(0))).collect() == []
