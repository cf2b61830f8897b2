import random

import pytest
from scriptorium.llm import licenses


@pytest.fixture(scope="module")
def model(spark, sf):
    return licenses.fit(licenses.negatives(spark.read.parquet(f"{sf}/documents.parquet")))


def test_templates_are_found(model):
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            assert [p["family"] for p in model.scan(f"before\n{t}\nafter")] == [family], t


def test_held_out_spellings(model):
    """Notices that weren't trained on, word by word, against ordinary text."""
    cases = {
        "This file is licensed under the Apache License, Version 2.0": "Apache-2.0",
        "released under the mit license": "MIT",
        "The work is licensed under the GNU General Public License, version 3": "GPL",
        "licensed under CC-BY-NC 4.0": "CC-BY-NC",
        "(c) 2021 Somebody. All rights reserved.": "Proprietary",
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    }
    for text, family in cases.items():
        assert [p["family"] for p in model.scan(text)] == [family], text
    for text in (*licenses.NEAR_MISSES, "the license of the driver is under the seat", "the rights of the people are reserved for all", "version 2.0", "The general public was under the impression of a free work."):
        assert model.scan(text) == [], text


def test_held_out_accuracy(model, spark, sf):
    rng = random.Random(5)
    words = [w for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect() for w in r["text"].split()][:4000]
    right = wrong = 0
    for _ in range(300):
        family = rng.choice(sorted(licenses.TEMPLATES))
        t = rng.choice(licenses.TEMPLATES[family])
        line = " ".join([*rng.choices(words, k=rng.randrange(3)), t, *rng.choices(words, k=rng.randrange(3))])
        right += [p["family"] for p in model.scan(line)] == [family]
        wrong += bool(model.scan(" ".join(rng.choices(words, k=20))))
    assert right >= 290 and wrong == 0


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in the Software
without restriction""",
    "GPL": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met""",
    "Apache-2.0": """Licensed under the Apache License,
Version 2.0 (the License); you may not
use this file except in compliance
with the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms
of the Mozilla Public License, v. 2.0.""",
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_notices(model, mark):
    """Notices over several lines, with comment marks, between other lines; spans begin and end with the notice."""
    for family, text in WRAPPED.items():
        notice = "\n".join(mark + x for x in text.split("\n"))
        for before, after in (("", ""), ("int main;\n\n", "\n\nreturn"), (f"{mark}tool.py, a tool\n{mark}\n", f"\n{mark}\ncode"), ("Some words came before it\n", "\nAnd others went after it")):
            got = model.scan(before + notice + after)
            assert [(p["family"], p["start"]) for p in got] == [(family, len(before))], (family, before)
            assert 0.75 * len(notice) < got[0]["end"] - len(before) <= len(notice)


def test_unknown_class_is_calibrated(model, spark, sf):
    """Held-out cases that aren't a family's stay under its least; the least isn't one fixed number; probabilities are near shares."""
    import numpy as np

    words, labels, held = licenses.cases(licenses.negatives(spark.read.parquet(f"{sf}/documents.parquet")))
    out = [(w, k) for w, k, h in zip(words, labels, held, strict=True) if h]
    p = np.array([model.probabilities(w) for w, _ in out])
    own = np.array([k for _, k in out])[:, None] == np.arange(len(model.families))
    assert (p < model.least)[~own].all()
    assert (p >= model.least)[own].mean() > 0.9
    assert len({round(float(x), 3) for x in model.least}) > len(model.least) / 2
    assert abs(p.sum() - own.sum()) < 0.1 * own.sum()
    # None of what was held out was trained on.
    trained = {tuple(w) for w, k, h in zip(words, labels, held, strict=True) if not h and k == -1}
    assert not trained & {tuple(licenses.tokens(x)) for i, x in enumerate(licenses.NEAR_MISSES) if i % 5 == 0}


def test_platt_finds_known_probabilities():
    import numpy as np

    rng = np.random.default_rng(0)
    z = rng.normal(0, 3, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.7 * z - 1)))).astype(float)
    a, b = licenses.platt(z, y)
    assert abs(a - 0.7) < 0.05 and abs(b + 1) < 0.1


def brute_scan(model, text):
    """Every run of lines without a blank one between, shortest first, without a bound on what words can give."""
    lines, at = [], 0
    for x in (text or "").split("\n"):
        lines.append((at, at + len(x), licenses.tokens(x)))
        at += len(x) + 1
    taken, out = set(), []
    for size in range(1, len(lines) + 1):
        for i in range(len(lines) - size + 1):
            part = lines[i : i + size]
            words = [w for _, _, ws in part for w in ws]
            if any(not ws for _, _, ws in part) or (size > 1 and len(words) > model.width) or taken & set(range(i, i + size)):
                continue
            p = model.probabilities(words)
            good = [k for k in range(len(p)) if p[k] >= model.least[k]]
            if not good:
                continue
            k = max(good, key=lambda k: (p[k], -k))
            family, j = model.families[k], i + size
            if not any(licenses.shared(t, words) >= 0.8 * len(t) for t in model.templates[family]):
                continue
            good = lambda whole, line: any(2 * (licenses.shared(t, whole) - licenses.shared(t, words)) >= len(line) for t in model.templates[family])  # noqa: E731, B023
            while j < len(lines) and (x := lines[j][2]) and j not in taken and len(words) + len(x) <= model.width and good(words + x, x):
                words, j = words + x, j + 1
            while i and (x := lines[i - 1][2]) and i - 1 not in taken and len(words) + len(x) <= model.width and good(x + words, x):
                words, i = x + words, i - 1
            taken |= set(range(i, j))
            out.append((family, lines[i][0], lines[j - 1][1]))
        if size > model.width:
            break
    return sorted(out, key=lambda x: x[1])


def test_query_by_brute_force(model, spark, sf):
    """All rows of the query, against every passage scored without shortcuts; and hard texts."""
    from scriptorium.llm.queries import op3_license_scan

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = licenses.fit(licenses.negatives(docs.select("doc_id", "text")))
    want = {}
    for r in docs.collect():
        found = brute_scan(own, r["text"])
        want[r["doc_id"]] = (len(found), ",".join(sorted({f for f, _, _ in found})), ",".join(f"{f}:{a}:{b}" for f, a, b in found))
    got = {r["doc_id"]: (r["n_licenses"], r["families"], r["spans"]) for r in op3_license_scan(spark, sf).collect()}
    assert got == want and sum(n for n, _, _ in got.values()) > 0
    rng = random.Random(8)
    pieces = [x for t in WRAPPED.values() for x in t.split("\n")] + ["", "the", "All rights reserved.", "of the license", "free software and use", *licenses.NEAR_MISSES]
    for _ in range(150):
        text = "\n".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert [(p["family"], p["start"], p["end"]) for p in model.scan(text)] == brute_scan(model, text), text


def test_very_long_texts(model):
    import time

    began = time.process_time()
    assert [p["family"] for p in model.scan("the\nof\n" * 3_000 + "\nAll rights reserved.\n" + "word " * 300_000)] == ["Proprietary"]
    assert time.process_time() - began < 30


def test_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x\nReleased under the MIT License.\n" + "y " * 50_000), (3, "😀😀\nAll rights reserved.")], "doc_id long, text string")
    got = licenses.report(df).collect()
    assert len(got) == 5
    by = {r["doc_id"]: [(p["family"], p["start"], p["end"]) for p in r["paragraphs"]] for r in got}
    assert by == {1: [], 2: [], None: [("MIT", 2, 33)], 3: [("Proprietary", 3, 23)]}
    assert licenses.report(df.limit(0)).count() == 0


def test_sample_of_a_larger_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    some = licenses.negatives(docs, sample=30)
    assert 0 < len(some) <= 30 and some == licenses.negatives(docs.repartition(3), sample=30)
