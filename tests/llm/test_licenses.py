import math
import re

from strata.llm import licenses as lic

GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [w for w in GAP.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


TEXTS = [
    None,
    "",
    "!!! \n\n --",
    "Released under the MIT License.",
    "under the MIT\nLicense",
    "This work, licensed under the GNU General Public License: version 3!\nx\nthis work is licensed under the gnu public license version 3",
    "cc-by CC BY cc   by-nc",
    "licensed under Apache License 2.0\nlicensed licensed licensed licensed",
    "mit mit license license",
    "the of in and " * 9000 + "Apache License",
    "permission is hereby granted free of charge to any person obtaining a copy",
    "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following holds",
    "x y z " * 40 + "\n * Permission is hereby granted,\n * free of charge, to any\n * person obtaining a copy of\n * this software" + " a b" * 50,
    "any copy of this source is free and in use by the person",
]


#: Whole licenses: wrapped anew, with words left out, changed or put in between.
LONG = [t for t, _ in lic.TEMPLATES if len(t) > 300]
TEXTS += [f"x y {' '.join(t.split())} z" for t in LONG] + ["\n * ".join(t.split(", ")) + " of the in" * 300 for t in LONG]
TEXTS += [" ".join(w for i, w in enumerate(t.split()) if i % k) for t in LONG for k in (3, 5, 7, 11)] + [" ".join(f"{w} filler" for w in t.split()) for t in LONG]


def brute(text):
    w = words(text)
    base = [(i, label) for i in range(len(w)) for p, label in lic.PHRASES if w[i : i + len(p.split())] == p.split()]
    blocks = []
    for c in lic.classes(lic.TEMPLATES):
        for n in range(0, max(1, -(-len(w) // c.longest) - 1) * c.longest, c.longest):
            own = set(w[n : n + 2 * c.longest])
            for label, t in c.sets:
                if len(own & set(t)) >= math.ceil(lic.THRESHOLD * len(t) - 1e-9):
                    blocks.append((n, label, len(own & set(t)) / len(t)))
    return len(w), sorted(base), sorted(blocks)


def test_against_brute_force(spark):
    rows = [(i, t, "b") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "b"), (3, "other text under one id", "b"), (None, TEXTS[3], "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, [(p.at, p.label) for p in r.places], [(b.block, b.label, b.containment) for b in r.blocks]) for r in lic.scan(df).collect())
    assert got == sorted((i is None, i or 0, *brute(t)) for i, t, _ in rows)


def test_wrapped_notices_are_found(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS[11:14])), "doc_id long, text string")
    assert {r.doc_id: {b.label for b in r.blocks} for r in lic.scan(df).collect()} == {0: {"bsd"}, 1: {"mit-text"}, 2: set()}


def test_empty_table_and_no_templates(spark):
    df = spark.createDataFrame([(1, TEXTS[3])], "doc_id long, text string")
    assert lic.scan(df.limit(0)).collect() == []
    (r,) = lic.scan(df, given=()).collect()
    assert r.blocks == [] and len(r.places) == 1


def test_classes_by_size():
    made = lic.classes(lic.TEMPLATES)
    assert sum(len(c.sets) for c in made) == len(lic.TEMPLATES) and [c.longest for c in made] == sorted(c.longest for c in made)
    assert all(c.longest >= max(len(t) for _, t in c.sets) for c in made) and lic.classes(()) == []


def test_whole_licenses_are_found(spark):
    df = spark.createDataFrame([(i, " ".join(t.split()).upper()) for i, t in enumerate(LONG)], "doc_id long, text string")
    label = {i: x for i, x in enumerate(x for t, x in lic.TEMPLATES if len(t) > 300)}
    assert all((label[r.doc_id], 1.0) in {(b.label, b.containment) for b in r.blocks} for r in lic.scan(df).collect())
