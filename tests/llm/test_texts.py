"""Ops 2, 3, 4, 5 and 9: texts one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import fingerprint, langid, licences, tokens, toxicity

from .conftest import WORDS, sorted_rows


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


# ---- toxicity ----


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(4)
    bad = ["blarg", "zonk", "fnord"]
    rows = []
    for i in range(400):
        words = [rng.choice(WORDS["en"]) + rng.choice(["", "s", "x", "er"]) for _ in range(rng.randint(30, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out_texts(speech):
    model = toxicity.train(speech.select("doc_id", "text"), speech.select("doc_id", "toxic"))
    got = toxicity.score(speech, model).join(speech.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(got) > 60
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert right >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_toxicity_edge_cases(docs, rows, nothing, speech):
    model = toxicity.train(speech.select("doc_id", "text"), speech.select("doc_id", "toxic"))
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    assert {(r["doc_id"], r["held_out"]) for r in got.collect()} == {(r[0], held(r[0])) for r in rows}
    empty = {r["score"] for r in got.collect() if r["doc_id"] in (5, 6, 7)}
    assert len(empty) == 1
    assert toxicity.score(nothing, model).collect() == []
    untrained = toxicity.train(nothing, speech.select("doc_id", "toxic"))
    assert {r["predicted"] for r in toxicity.score(docs, untrained).collect()} == {0}
    assert toxicity.score(docs, model, keep=["text", "kept"]).where("doc_id = 3").select("kept.*").first()["kept"] == "x"


def counted_plainly(rows, texts):
    """Counts of (text, label, fold) and of all texts, as their definitions say."""
    n = len(rows)
    texts_of = {}
    for t, _, _ in rows:
        for w in set(toxicity.words(t)) | {w[-2:] + "$" for w in toxicity.words(t)}:
            texts_of[w] = texts_of.get(w, 0) + 1
    ids = {w: i for i, w in enumerate(sorted(w for w, k in texts_of.items() if k >= toxicity.least(toxicity.LEAST_WORD, n)), 1)}
    number = lambda t: [0] + [ids.get(w) or ids.get(w[-2:] + "$", 0) for w in toxicity.words(t)]
    pairs = lambda t: list(zip(number(t), number(t)[1:]))
    return ids, pairs


def plain_ratio(rows, texts, pair, fold, ids, pairs):
    """The difference of the log-likelihoods of ``pair``, from the formulas of interpolated Kneser-Ney."""
    v, logs = len(ids) + 1, []
    everything = {p for t in texts for p in pairs(t)}
    held = {}
    for t, _, _ in rows:
        for p in set(pairs(t)):
            held[p] = held.get(p, 0) + 1
    own = {p for p, k in held.items() if k >= toxicity.least(toxicity.LEAST_PAIR, len(rows))}
    follows = lambda w: len({a for a, b in everything if b == w})
    for y in (0, 1):
        n = {}
        for t, label, f in rows:
            if label == y and f != fold:
                for p in pairs(t):
                    n[p] = n.get(p, 0) + 1
        before = {}
        for _, b in n:
            before[b] = before.get(b, 0) + 1
        count = lambda d, k: sum(x == k for x in d.values())
        low_d = count(before, 1) / (count(before, 1) + 2 * count(before, 2)) if count(before, 1) else 0.5
        d = count(n, 1) / (count(n, 1) + 2 * count(n, 2)) if count(n, 1) else 0.5
        shared = (follows(pair[1]) + 1) / (len(everything) + v)
        lower = max(before.get(pair[1], 0) - low_d, 0) / sum(before.values()) + sum(min(x, low_d) for x in before.values()) / sum(before.values()) * shared
        total = sum(k for (a, _), k in n.items() if a == pair[0])
        direct = lambda p: max(n.get(p, 0) - d, 0) / max(total, 1) if p in own else 0.0
        left = max(1 - sum(direct((pair[0], b)) for b in {b for a, b in own if a == pair[0]}), 1e-3)
        logs.append(np.log(direct(pair) + left * lower))
    return logs[1] - logs[0]


def test_models_are_those_of_the_formulas(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_PAIR", (4, 0.0))
    monkeypatch.setattr(toxicity, "HELD", 40)
    rng = random.Random(8)
    rows = [(" ".join(rng.choice("ab cab bad dab add bed rare%d cab ab" % i).replace(" ", "") + rng.choice(["", "ab"]) for _ in range(rng.randint(0, 14))), i % 2, i % toxicity.FOLDS) for i in range(60)]
    texts = [t for t, _, _ in rows] + ["bad cab neverlabelled", "", "ab ab ab"]
    got = toxicity.count(spark.createDataFrame(rows, "text string, y int, fold int").repartition(3), spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    ids, pairs = counted_plainly(rows, texts)
    assert got.ids == ids and len(got.pairs)
    for fold in (None, 0, 3):
        model = toxicity.Model.of(got, fold)
        for t in (rows[3][0], rows[10][0], "bad cab neverlabelled ab ab"):
            want = [plain_ratio(rows, texts, p, fold, ids, pairs) for p in pairs(t)]
            assert np.allclose(model.differences(toxicity.words(t)), want, atol=1e-4)


def test_one_of_several_labels(spark, speech):
    """The larger label of an id counts, and ids without one are nobody's."""
    labels = speech.select("doc_id", "toxic")
    more = labels.unionByName(labels.where("toxic = 1").withColumn("toxic", F.lit(0))).unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 7)], labels.schema))
    a, b = (toxicity.train(speech.select("doc_id", "text"), x) for x in (labels, more))
    assert a.ids == b.ids and a.scale == b.scale and (a.single == b.single).all()


# ---- fingerprints ----


def test_fingerprints_of_all_rows(docs, rows, nothing):
    got = fingerprint.fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 4
        want.append((r[0], len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    by_text = {}
    for r in got:
        by_text.setdefault(next(x[1] or "" for x in rows if x[0] == r["doc_id"]), set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprint.fingerprints(nothing).collect() == []
    assert fingerprint.fingerprints(docs.where("doc_id = 3").limit(1)).first()["near_next"] == 1.0


def test_ranges_are_dealt_one_to_a_partition(spark):
    df = spark.createDataFrame([(i, f"text {i}. More of it.") for i in range(800)], "doc_id long, text string").repartition(4)
    out = fingerprint.fingerprints(df)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) <= 2.5 * 800 / len(sizes)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == 800 and rows[799]["near_next"] == fingerprint.likeness(fingerprint.digests("text 799. More of it."), fingerprint.digests("text 0. More of it."))


@pytest.mark.parametrize("n", [0, 1, 5, 40, 700])
def test_differences_are_recovered(n):
    rng = random.Random(n)
    both = [rng.getrandbits(64) for _ in range(200)]
    a, b = [rng.getrandbits(64) for _ in range(n)], [rng.getrandbits(64) for _ in range(n // 2)]
    mine, theirs = fingerprint.differing(both + a, both + b)
    assert (sorted(mine), sorted(theirs)) == (sorted(a), sorted(b))


def test_likeness_is_jaccard_of_parts():
    text = ".".join(f"sentence number {i} of some" for i in range(40)) + "."
    a, b = fingerprint.digests(text), fingerprint.digests(text[: len(text) // 2])
    assert fingerprint.likeness(a, b) == pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b)))
    assert fingerprint.likeness(a, a) == 1.0 == fingerprint.likeness([], [])
    assert "".join(fingerprint.parts(text)) == text
    x = fingerprint.digests("a\n" * 50)
    assert len(x) == len(set(x)) == 50


# ---- languages ----


def test_languages_of_held_out_texts(docs, rows, nothing):
    filters = langid.train(docs)
    got = langid.identify(docs, filters).collect()
    assert len(got) == len(rows)
    langs = {r[0]: r[2] for r in rows}
    judged = [r for r in got if r["held_out"] and langs[r["doc_id"]] and r["doc_id"] not in (6, 7, 8, 9) and r["doc_id"] % 10 < 8]
    assert judged and sum(r["lang_pred"] == langs[r["doc_id"]] for r in judged) >= 0.9 * len(judged)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (5, 6, 7))
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    assert langid.identify(nothing, filters).collect() == []
    none = langid.train(nothing)
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_filters_lose_no_ngram_and_count_corrections():
    texts = {x: [" ".join(WORDS[x])] * 3 for x in WORDS}
    f = langid.Filters.of(texts)
    for i, name in enumerate(f.languages):
        counts, n = f.counts(texts[name][0])
        assert counts[i] == pytest.approx(n, rel=0.01)
    assert f.predict("1234 !!") == ("und", 0.0) and f.predict(None) == ("und", 0.0)
    many = langid.Filters.of({f"l{i:02d}": [f"word{chr(97 + i)} other{chr(97 + i)}"] for i in range(20)})
    assert many.masks.dtype == "uint64" and many.predict("otherc")[0] == "l02"


def test_more_languages_than_a_word_has_bits():
    rng = random.Random(3)
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for i in range(150)}
    filters = langid.Filters.of({k: [" ".join(rng.choice(v) for _ in range(60)) for _ in range(3)] for k, v in words.items()})
    assert filters.masks.shape[1] == 3
    assert all(filters.predict(" ".join(rng.choice(v) for _ in range(30)))[0] == k for k, v in words.items())


def test_languages_as_plain_sets_of_ngrams_tell_them(docs, rows):
    """Filters give what sets of n-grams, made from the same texts by plain means, give, wherever the sets tell two languages apart."""
    def grams(text):
        out = " "
        for c in text.lower() + " ":
            out += c if c.isalpha() else "" if out[-1] == " " else " "
        return [out[i : i + langid.GRAM] for i in range(len(out) - langid.GRAM + 1)]

    shares = {}
    for lang in ("en", "fr", "de"):
        n = {}
        for t in [r[1] for r in rows if r[2] == lang and r[1] and not held(r[0])]:
            for g in grams(t):
                n[g] = n.get(g, 0) + 1
        shares[lang] = {g: k / sum(n.values()) for g, k in n.items()}
    most = {}
    for own in shares.values():
        for g, x in own.items():
            most[g] = max(x, most.get(g, 0))
    sets = {k: {g for g, x in own.items() if x >= langid.LEAST_SHARE and x >= langid.LEAST_PART * most[g]} for k, own in shares.items()}
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, langid.train(docs)).collect()}
    checked = 0
    for doc, text, *_ in rows:
        if text and any(map(str.isalpha, text)) and len(grams(text)) > 20:
            hits = sorted(((sum(g in s for g in grams(text)), k) for k, s in sets.items()), reverse=True)
            if hits[0][0] > 1.1 * hits[1][0]:
                checked += 1
                assert (doc, hits[0][1]) in got
    assert checked > 30


# ---- tokens ----


def test_token_counts(docs, rows, nothing, tokenizers):
    from tokenizers import Tokenizer

    path = tokenizers("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = [(r[0], len((r[1] or "").encode()), n := len(t.encode(r[1] or "", add_special_tokens=False)), n > 100) for r in rows]
    assert sorted_rows(tokens.count_tokens(docs, path, limit=100)) == sorted(want, key=repr)
    assert tokens.count_tokens(nothing, path).collect() == []


def test_token_counts_of_odd_texts(tokenizers):
    path = tokenizers("word_bpe_49k.json")
    c = tokens.WordCounter(open(path, encoding="utf-8").read())
    rng = random.Random(1)
    letters = "aA'sStT  \n\t\x1c\x85\xa0éÉ́ΣσİIßſK1²½_-!<|endoftext|>中あ한😀​﻿"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) + rng.choice(["", "<|endoftext|>", "<|startoftext|>x", "'LL've"])
        assert c.count(text) == len(c.tokenizer.encode(text, add_special_tokens=False)), repr(text)


# ---- licences ----

NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mpl-2.0": "SPDX-License-Identifier: MPL-2.0",
}


def test_licences(spark, docs, rows, nothing):
    scanner = licences.train(licences.paragraph_sample(docs))
    cases = [(i, f"Some text before.\n{t}\nAnd after.", f) for i, (f, t) in enumerate(NOTICES.items())]
    cases += [(10, "the public license of this version is under that", "unknown"), (11, "We licensed nothing.", "unknown"), (12, None, "unknown"), (13, "", "unknown")]
    df = spark.createDataFrame([(i, t, 1) for i, t, _ in cases], "doc_id long, text string, family int")
    got = {r["doc_id"]: r for r in licences.scan(df, scanner).collect()}
    assert {i: got[i]["family"] for i, _, _ in cases} == {i: f for i, _, f in cases}
    assert all((got[i]["score"] > 0.5) == (f != "unknown") for i, _, f in cases)
    assert licences.scan(docs, scanner).where("n_notices > 0").count() == 0 and licences.scan(docs, scanner).count() == len(rows)
    assert licences.scan(nothing, scanner).collect() == []
    plan = licences.scan(df, scanner)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange", "Join", "Generate"))


def test_anchors_reach_every_confirmed_paragraph():
    words = set(licences.anchors())
    for templates in licences.TEMPLATES.values():
        for t in templates:
            grams = licences.grams(licences.terms(t))
            without = [g for g in grams if not words & set(g.split())]
            assert len(without) < licences.CONTAINED * len(grams)


def test_licence_scores_equal_a_plain_computation(spark):
    import numpy as np

    scanner = licences.train(["an ordinary paragraph of words", "and another one of them"])
    text = "Released under the MIT License for all"
    got = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), scanner).first()
    at = [scanner.known.index(g) for g in licences.grams(licences.terms(text)) if g in scanner.known]
    z = scanner.scale * (np.round(scanner.bias, 4) + np.round(scanner.weights[at], 4).sum(axis=0))
    assert got["score"] == pytest.approx(float(np.exp(z.max()) / (1 + np.exp(z).sum())), rel=1e-6)


def test_held_out_is_never_learnt(speech):
    seen = toxicity.train(speech.select("doc_id", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, "secret secret").otherwise(F.col("text")).alias("text")), speech.select("doc_id", "toxic"))
    assert "secret" not in seen.ids


def test_all_labelled_texts_are_counted(spark, speech):
    rows = speech.unionByName(spark.createDataFrame([(i, "quux corge grault", 0) for i in range(1000, 1200)] + [(2000 + i, "quux unlabelled", None) for i in range(40)], "doc_id long, text string, toxic int"))
    labels = rows.select("doc_id", "toxic").where("toxic is not null")
    model = toxicity.train(rows.select("doc_id", "text"), labels, sample=10)
    assert {"quux", "corge", "zonk", "blarg", "fnord"} <= set(model.ids) and "unlabelled" not in model.ids


def test_the_curve_is_of_all_labelled_texts(spark):
    rng = random.Random(6)
    # Ordinary texts with the largest hashes, which a sample of the smallest has none of, look like toxic ones.
    last = {r["id"] for r in spark.range(2600).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) >= int(0.85 * (1 << 30))).collect()}
    rows = [(i, " ".join(rng.choice(WORDS["en"] + ["zonk"] * (2 * (i % 12 == 0 or i in last))) for _ in range(12)), int(i % 12 == 0)) for i in range(2600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(toxicity.FOLDS)).cast("int").alias("fold")
    labelled = docs.select("doc_id", "text", F.col("toxic").alias("y"), fold)
    known = [r for r in labelled.collect() if not held(r["doc_id"])]
    assert sum(not r["y"] for r in known) > 1600
    learnt = labelled.where(F.col("doc_id").isin([r["doc_id"] for r in known])).select("text", "y", "fold")
    counts = toxicity.count(learnt, learnt.select("text"))
    models = [toxicity.Model.of(counts, f) for f in range(toxicity.FOLDS)]
    x = np.array([models[r["fold"]].outstanding(toxicity.words(r["text"]), (model.margin,))[0] for r in known])
    y = np.array([r["y"] for r in known], float)
    p = 1 / (1 + np.exp(-(model.scale[0] * x + model.scale[1])))
    # Where the likelihood of all is largest, what is predicted sums to what is so, but for a small ridge.
    assert abs((y - p).mean()) < 2e-4 and abs(((y - p) * x).mean()) < 2e-4


def test_all_texts_teach_their_language(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(8)), "xy"[i % 16 == 0]) for i in range(5600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    known = {name: [t for i, t, lang in rows if lang == name and not held(i)] for name in "xy"}
    assert len(known["x"]) > 3600
    got, want = langid.train(docs), langid.Filters.of(known)
    assert got.languages == want.languages and (got.masks == want.masks).all() and (got.wrong == want.wrong).all()


def scanned(spark, texts):
    scanner = licences.train(["an ordinary paragraph of words", "and another one of them"])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["n_notices"], r["families"]) for r in sorted(licences.scan(df, scanner).collect(), key=lambda r: r["doc_id"])]


def test_wrapped_notices(spark):
    import textwrap

    long = {f: max(licences.TEMPLATES[f], key=len) for f in ("bsd-3-clause", "mit", "isc")}
    texts, want = [], []
    for f, t in long.items():
        for width, mark in ((80, ""), (72, " * "), (60, "# "), (40, "// ")):
            texts.append("int x;\n\n" + "\n".join(mark + line for line in textwrap.wrap(t, width)) + f"\n{mark}\n{mark}Other words follow.\n")
            want.append((1, f))
    assert scanned(spark, texts) == want


def test_headers_of_source_files(spark):
    gpl = "/*\n * This program is free software; you can redistribute it and/or modify it under\n * the terms of the GNU {} as published by the\n * Free Software Foundation; either version {} of the License, or (at your\n * option) any later version.\n */\nint main() {{}}\n"
    apache = "# Licensed under the Apache License, Version 2.0\n# (the \"License\"); you may not use this file except in compliance with\n# the License.  You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n"
    short = "// Licensed under the Apache License,\n// Version 2.0.\nx = 1\n"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and\nassociated documentation files (the \"Software\"), to deal in the Software without restriction, including\nwithout limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the\nfollowing conditions:\n"
    mpl = "-- This Source Code Form is subject to the terms of the Mozilla Public\n-- License, v. 2.0. If a copy of the MPL was not distributed with this\n-- file, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
    texts = [gpl.format("General Public License", 2), gpl.format("General Public License", 3), gpl.format("Lesser General Public License", 3), gpl.format("Affero General Public License", 3), apache, short, mit, mpl]
    assert [f for _, f in scanned(spark, texts)] == ["gpl-2.0", "gpl-3.0", "lgpl-3.0", "agpl-3.0", "apache-2.0", "apache-2.0", "mit", "mpl-2.0"]


def test_several_notices_in_a_line(spark):
    filler = "ordinary words go on and on here " * 20
    mit, apache, gpl, nc = NOTICES["mit"], NOTICES["apache-2.0"], NOTICES["gpl-3.0"], NOTICES["cc-by-nc-4.0"]
    texts = [f"{mit} {apache}", f"{filler}{mit} {filler}{gpl} {filler}{nc}", f"{mit} {filler}{mit}", f"{mit}\n{mit}", "This work is licensed under the GNU Lesser General Public License version 3", *(t for f, ts in sorted(licences.TEMPLATES.items()) for t in ts)]
    want = [(2, "apache-2.0,mit"), (3, "cc-by-nc-4.0,gpl-3.0,mit"), (2, "mit"), (2, "mit"), (1, "lgpl-3.0"), *((1, f) for f, ts in sorted(licences.TEMPLATES.items()) for _ in ts)]
    assert scanned(spark, texts) == want


def plainly_scanned(text, scanner):
    """Notices of a text by the rules that the module states, in plain Python: (family, score) in order."""
    found = re.compile(r"(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, licences.anchors())) + ")(?![a-z0-9])")
    templates = [[set(licences.grams(licences.terms(t))) for t in licences.TEMPLATES[f]] for f in scanner.families]
    marks = [{g for t in ts for g in t if not (licences.PLAIN | licences._STOP) & set(g.split())} for ts in templates]

    def judged(words):
        g = set(licences.grams(words))
        z = np.round(scanner.bias, 4) + sum((np.round(scanner.weights[i], 4) for i, k in enumerate(scanner.known) if k in g), np.zeros(len(scanner.families)))
        power = np.exp(scanner.scale * np.minimum(z, 200))
        sure = [i for i, ts in enumerate(templates) if any(len(t & g) >= licences.CONTAINED * len(t) for t in ts)]
        rank = lambda i: (-len(marks[i] & g), -power[i], i)
        kept = [i for i in sure if not (better := [j for j in sure if rank(j) < rank(i)]) or (marks[i] & g) - set().union(*(t for j in better for t in templates[j]))]
        rivals = 1 + sum(power[i] for i in range(len(power)) if i not in kept)
        return [(scanner.families[i], power[i] / (power[i] + rivals)) for i in kept if power[i] >= licences.LEAST * (power[i] + 1)]

    def in_windows(words):
        starts = range(0, max(1, -(-(len(words) - licences.WINDOW) // licences.STEP) + 1), 1)
        each = [judged(w) if found.search(" ".join(w)) else [] for w in (words[i * licences.STEP : i * licences.STEP + licences.WINDOW] for i in starts)]
        return [n for i, own in enumerate(each) for n in own if not i or n[0] not in {f for f, _ in each[i - 1]}]

    out = []
    for p in re.split(r"\n(?:[\W_]*\n)+", text or ""):
        if found.search(p):
            one = [n for line in p.split("\n") if found.search(line) for n in in_windows(licences.terms(line))]
            both = in_windows(licences.terms(p)) if "\n" in p else []
            times = lambda among, f: sum(x[0] == f for x in among)
            out += one if "\n" not in p else [n for n in one if times(one, n[0]) >= times(both, n[0])] + [n for n in both if times(both, n[0]) > times(one, n[0])]
    return out


def test_all_notices_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scanner = licences.train(licences.paragraph_sample(docs))
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([f"{NOTICES['mit']} {NOTICES['apache-2.0']}\nor\n{NOTICES['mit']}\n\n{NOTICES['gpl-3.0']}", "Licensed under the Apache\nLicense, Version 2.0\n--\nLicensed"])], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    got = {r["doc_id"]: r for r in licences.scan(rows, scanner).collect()}
    some = 0
    for r in rows.collect():
        want, have = plainly_scanned(r["text"], scanner), got[r["doc_id"]]
        some += bool(want)
        assert have["n_notices"] == len(want) and have["families"] == ",".join(sorted({f for f, _ in want})), r["text"]
        assert have["score"] == pytest.approx(max((x for _, x in want), default=0.0), abs=1e-6)
        if want:
            assert have["family"] == next(f for f, x in want if x == max(y for _, y in want))
    assert some > 3


def test_ordinary_text_is_sampled_whole(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"w{i} v{j}" for j in range(200))) for i in range(50)] + [(90, None), (91, ""), (92, "short one")], "doc_id long, text string")
    got = licences.paragraph_sample(docs, most=1000)
    assert "short one" in got and {len(x.split()) for x in got} == {0, 2, licences.WINDOW}
    assert len({x.split()[1] for x in got if len(x.split()) > 2}) > 20  # not all from where a text begins
    assert len(licences.paragraph_sample(docs, most=10)) < 30
