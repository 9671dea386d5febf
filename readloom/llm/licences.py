"""Licence scans in SQL functions only.

A multinomial logistic regression over word n-grams of known notices tells licence families apart and from ordinary
text, whose class is ``unknown``; a temperature fitted on paragraphs that training didn't see calibrates its
probabilities.  A family counts if its text also holds most n-grams of one of its templates.  Notices are sought in
each line and in overlapping windows of words of each paragraph, since they are wrapped over lines as often as several share one;
of families confirmed together, one that less is found of stays if the templates of the others don't explain what it is known by.

Scoring runs inside the JVM row by row: no explode, join or shuffle.  Weights and templates travel as one constant.
Paragraphs are first searched for anchors: words chosen so that every template has more n-grams with an anchor than a
confirmed paragraph may lack.  A paragraph without one can't be confirmed, so nothing is lost by passing over it.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices by family.
TEMPLATES = {
    "agpl-3.0": ["licensed under the GNU Affero General Public License version 3", "SPDX-License-Identifier: AGPL-3.0-or-later", "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "artistic-2.0": ["released under the Artistic License 2.0", "SPDX-License-Identifier: Artistic-2.0"],
    "bsd-3-clause": ["released under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc-by-4.0": ["licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc-4.0": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "cc-by-sa-4.0": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "cc0-1.0": ["dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "epl-2.0": ["made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "gpl-2.0": ["licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "lgpl-3.0": ["licensed under the GNU Lesser General Public License version 3", "SPDX-License-Identifier: LGPL-3.0-or-later", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mpl-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "proprietary": ["Confidential and proprietary. All rights reserved", "Copyright. All rights reserved. No part may be reproduced without permission"],
}
UNKNOWN = "unknown"
#: Part of a template's n-grams that a paragraph has to hold; probability that a family has to reach.
CONTAINED, LEAST = 0.7, 0.5
#: Windows of the corpus that teach ordinary text, at most about: one of each of the texts with the smallest hashes; variants of a template to learn from.
BACKGROUND, VARIANTS = 400, 30
#: Words of a window and from one to the next: with no more than the difference, a notice falls into one window whole.
WINDOW, STEP = 48, 24
#: Words that don't tell families apart.
PLAIN = {"above", "deal", "file", "following", "forms", "free", "from", "made", "this", "used", "work", "with", "that", "under", "terms", "available", "part", "software", "person", "purpose", "without", "provided", "source", "subject"}
_STOP = {"a", "and", "any", "are", "be", "for", "in", "is", "may", "met", "no", "of", "or", "the", "to", "v"}
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def grams(words: list[str]) -> list[str]:
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def anchors() -> list[str]:
    """Words, those of most templates first and ordinary ones last, until more of each template's n-grams hold one than may be lacking."""
    every = [(t, grams(terms(t))) for ts in TEMPLATES.values() for t in ts]
    used: dict[str, int] = {}
    for _, gs in every:
        for w in {w for g in gs for w in g.split()}:
            used[w] = used.get(w, 0) + 1
    chosen: set[str] = set()
    for _, gs in every:
        for w in sorted({w for g in gs for w in g.split()}, key=lambda w: (w not in chosen, len(w) < 4 and w not in ("gnu", "cc0", "mit", "bsd"), w in PLAIN, -used[w], w)):
            if sum(any(x in chosen for x in g.split()) for g in gs) > (1 - CONTAINED) * len(gs):
                break
            chosen.add(w)
    return sorted(chosen)


@dataclass
class Scanner:
    """A scoring table: known n-grams by slot, their weights by family, a bias and a scale."""

    families: list[str]
    known: list[str]
    weights: np.ndarray  # an n-gram a row
    bias: np.ndarray
    scale: float

    def constant(self) -> Column:
        """Everything the expression needs, as one literal."""
        templates = [[grams(terms(t)) for t in TEMPLATES[f]] for f in self.families]
        data = {"families": self.families, "known": self.known, "weights": [[round(float(x), 4) for x in w] for w in self.weights], "bias": [round(float(x), 4) for x in self.bias], "templates": templates, "marks": [sorted({g for t in ts for g in t if not (PLAIN | _STOP) & set(g.split())}) for ts in templates]}
        return F.from_json(F.lit(json.dumps(data)), "families array<string>, known array<string>, weights array<array<double>>, bias array<double>, templates array<array<array<string>>>, marks array<array<string>>")


def train(paragraphs: list[str], seed: int = 5) -> Scanner:
    """Learns from variants of the templates (words lost, ordinary words around) and from ``paragraphs`` of ordinary text.

    Ordinary text also comes as words of the templates out of their order.  Runs on the driver over a bounded number of rows.
    """
    rng = random.Random(seed)
    families = sorted(TEMPLATES)
    ordinary = [terms(p) for p in paragraphs if not re.search("|".join(anchors()), p.lower())] or [["some", "ordinary", "words"]]
    rows: list[tuple[list[str], int]] = []
    for i, family in enumerate(families):
        for t in TEMPLATES[family]:
            words = terms(t)
            for v in range(VARIANTS):
                own = [w for w in words if v == 0 or rng.random() > 0.1] or words
                before, after = (rng.choice(ordinary)[: rng.randint(0, 8)] if v % 3 else [] for _ in range(2))
                rows.append(([*before, *own, *after], i))
    everything = [w for ts in TEMPLATES.values() for t in ts for w in terms(t)]
    rows += [(p, len(families)) for p in ordinary]
    rows += [([rng.choice(everything) for _ in range(rng.randint(1, 12))], len(families)) for _ in range(BACKGROUND)]
    rng.shuffle(rows)
    known = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(terms(t))})
    at = {g: i for i, g in enumerate(known)}
    x = np.zeros((len(rows), len(known) + 1))
    x[:, -1] = 1
    for r, (words, _) in enumerate(rows):
        x[r, [at[g] for g in grams(words) if g in at]] = 1
    y = np.eye(len(families) + 1)[[k for _, k in rows]]
    fold = np.arange(len(rows)) % 5 == 0
    w = np.zeros((x.shape[1], y.shape[1]))

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(160):
        w -= 6.0 * (x[~fold].T @ (softmax(x[~fold] @ w) - y[~fold]) / (~fold).sum() + 1e-4 * w)
    z = x[fold] @ w
    scale = min((0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0), key=lambda s: -float(np.log((softmax(s * z) * y[fold]).sum(axis=1) + 1e-12).mean()))
    w = w - w[:, -1:]  # the unknown class is the reference: its logit is 0
    return Scanner(families, known, w[:-1, :-1], w[-1, :-1], scale)


def paragraph_sample(docs: DataFrame, text_col: str = "text", most: int = BACKGROUND) -> list[str]:
    """A window of words, at a place drawn by hash, of about ``most`` texts, those with the smallest hashes; all of a shorter text."""
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(text.alias("text"), F.xxhash64(text).alias("h"))
    share = int(min(1.0, most / max(1, rows.count())) * (1 << 30))
    words = rows.where(F.pmod("h", F.lit(1 << 30)) <= share).select("h", F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)).alias("w"))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.size("w") - WINDOW, F.lit(0)) + 1).cast("int")
    return sorted(r["p"] for r in words.select(F.array_join(F.slice("w", start + 1, WINDOW), " ").alias("p")).distinct().collect())


def scan(docs: DataFrame, scanner: Scanner, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``doc_id, n_notices, family, score, families``: confirmed notices, the family of the best one, and all families by name.

    Without a notice the family is ``unknown`` with score 0, so too where the text is null or empty.  Of equal scores the
    first paragraph's counts.  Repeated rows stay repeated; an empty table gives no rows.
    """
    k = scanner.constant()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = f"(?i)(?<![a-z0-9])(?:{'|'.join(re.escape(a) for a in anchors())})(?![a-z0-9])"
    paragraphs = F.when(text.rlike(found), F.filter(F.split(text, r"\n(?:[^\p{L}\p{N}\n]*\n)+"), lambda p: p.rlike(found))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<struct<score:double,family:string>>")

    def let(value: Column, fn) -> Column:
        return F.element_at(F.transform(F.array(value), fn), 1)

    def grams_of(words: Column) -> Column:
        pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(F.element_at(words, i + 1), F.lit(" "), w))
        return F.array_distinct(F.concat(words, pairs))

    def judged(g: Column) -> Column:
        # The sum of the weights of the n-grams that are known, one number a family.
        rows = F.filter(F.transform(g, lambda x: F.array_position(k["known"], x)), lambda i: i > 0)
        logits = F.aggregate(rows, k["bias"], lambda acc, i: F.zip_with(acc, F.element_at(k["weights"], i.cast("int")), lambda a, b: a + b))
        powers = F.transform(logits, lambda z: F.exp(F.lit(scanner.scale) * F.least(z, F.lit(200.0))))
        confirmed = F.filter(F.sequence(F.lit(1), F.lit(len(scanner.families))), lambda i: F.exists(F.element_at(k["templates"], i), lambda t: F.size(F.array_intersect(t, g)) >= F.lit(CONTAINED) * F.size(t)))
        return let(confirmed, lambda c: F.when(F.size(c) > 0, let(powers, lambda p: standing(g, c, p))).otherwise(none))

    def standing(g: Column, confirmed: Column, powers: Column) -> Column:
        at = lambda i: F.element_at(powers, i)

        marks = lambda i: F.array_intersect(F.element_at(k["marks"], i), g)

        def stays(i: Column) -> Column:
            more = lambda a, b: (F.size(marks(a)) > F.size(marks(b))) | ((F.size(marks(a)) == F.size(marks(b))) & ((at(a) > at(b)) | ((at(a) == at(b)) & (a < b))))
            better = F.filter(confirmed, lambda j: more(j, i))
            known_by = marks(i)
            return (F.size(better) == 0) | (F.size(F.array_except(known_by, F.flatten(F.flatten(F.transform(better, lambda j: F.element_at(k["templates"], j)))))) > 0)

        def judge(kept: Column) -> Column:
            total = lambda of: F.aggregate(of, F.lit(1.0), lambda a, j: a + at(j))
            every = F.sequence(F.lit(1), F.lit(len(scanner.families)))
            # Templates and marks decide between families, so only ordinary text can refute one; the score still counts those not kept as rivals.
            likely = F.filter(kept, lambda i: at(i) >= F.lit(least) * (at(i) + 1.0))
            return F.transform(likely, lambda i: F.struct((at(i) / (at(i) + total(F.array_except(every, kept)))).alias("score"), F.element_at(k["families"], i).alias("family")))

        return let(F.filter(confirmed, stays), judge)

    def words_of(p: Column) -> Column:
        return F.regexp_extract_all(F.lower(p), F.lit(_TERM), F.lit(0))

    def in_windows(words: Column) -> Column:
        """A family found in windows in a row counts once."""
        starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(words) - WINDOW) / STEP), F.lit(0)).cast("int"))
        windows = F.transform(starts, lambda i: F.slice(words, i * STEP + 1, WINDOW))
        each = F.transform(windows, lambda w: F.when(F.array_join(w, " ").rlike(found), let(grams_of(w), judged)).otherwise(none))
        return let(each, lambda e: F.flatten(F.transform(e, lambda own, i: F.filter(own, lambda n: (i == 0) | ~F.exists(F.element_at(e, F.greatest(i, F.lit(1))), lambda m: m["family"] == n["family"])))))

    def in_paragraph(p: Column) -> Column:
        """By family, what lines by themselves or all lines together hold, whichever is more."""
        lines = F.filter(F.split(p, "\n"), lambda x: x.rlike(found))
        one = F.flatten(F.transform(F.transform(lines, words_of), in_windows))
        times = lambda among, n: F.size(F.filter(among, lambda m: m["family"] == n["family"]))
        both = lambda a, b: F.concat(F.filter(a, lambda n: times(a, n) >= times(b, n)), F.filter(b, lambda n: times(b, n) > times(a, n)))
        return let(one, lambda a: F.when(F.instr(p, "\n") == 0, a).otherwise(let(let(words_of(p), in_windows), lambda b: both(a, b))))

    notices = F.flatten(F.transform(paragraphs, in_paragraph))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), notices.alias("notices"))
    top = F.array_max(F.transform("notices", lambda n: n["score"]))
    best = F.element_at(F.filter("notices", lambda n: n["score"] == top), 1)
    some = F.size("notices") > 0
    return out.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_notices"),
        F.when(some, best["family"]).otherwise(UNKNOWN).alias("family"),
        F.when(some, top).otherwise(0.0).alias("score"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"]))), ",").alias("families"),
    )
