"""Names in texts and overlapping boxes against brute force."""

from __future__ import annotations

import random
import re

from datalode.functions.names import without_names
from datalode.operators.decks import overlaps

r = random.Random(12)
WORDS = ["Ann", "Lee", "Jo", "van", "Berg", "Ünal", "x1", "the", "of"]


def brute_names(text, names):
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    known = {tuple(re.findall(r"[^\W_]+", n)) for n in names} - {()}
    out, i, last, n = [], 0, 0, 0
    while i < len(words):
        fit = [k for k in range(1, min(6, len(words) - i + 1)) if tuple(w for w, _, _ in words[i : i + k]) in known and all(re.fullmatch(r"[ \t\r\n]+", text[words[j][2] : words[j + 1][1]]) for j in range(i, i + k - 1))]
        if fit:
            k = max(fit)
            out += [text[last : words[i][1]], "<PERSON>"]
            last, i, n = words[i + k - 1][2], i + k, n + 1
        else:
            i += 1
    return "".join(out) + text[last:], n


def test_names_are_found_longest_first(spark):
    names = {" ".join(r.choice(WORDS[:7]) for _ in range(r.randint(1, 4))) for _ in range(25)} | {"Ann  Lee", "Jo-Berg", "...", ""}
    texts = ["".join(r.choice(WORDS) + r.choice([" ", " ", "\n", ", ", ".", "-", " — "]) for _ in range(r.randint(0, 40))) for _ in range(80)]
    texts += ["", "   ", "Ann", "Ann Lee", "(Ann\tLee)", "no name", "Annabel Leeds", texts[0], "Ann " * 3000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string").repartition(3)
    gaz = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = {x["i"]: (x["redacted"], x["n_names"]) for x in without_names(rows, gaz).collect()}
    assert got == {i: brute_names(t, names) for i, t in enumerate(texts)} | {len(texts): (None, 0)}
    assert {x["redacted"] for x in without_names(rows, gaz.limit(0)).collect()} == {*texts, None}


def test_boxes_meet_in_one_cell(spark):
    boxes = [(s, 100 * s + i, r.choice(["text", "footer"]) if s == 1 else "text", float(r.randint(-50, 400)), float(r.randint(-50, 400)), float(r.choice([0, 5, 30, 300])), float(r.choice([0, 5, 30]))) for s in range(3) for i in range(60)]
    boxes += [(9, 1, "text", 0.0, 0.0, 10.0, 10.0), (9, 2, "text", 10.0, 0.0, 10.0, 10.0), (9, 3, "text", 5.0, 5.0, 1e7, 1e7), (9, 4, "text", None, 0.0, 1.0, 1.0)]
    # a long row of boxes, each of which overlaps its neighbours only
    boxes += [(10, i, "text", 10.0 * i, 0.0, 12.0, 5.0) for i in range(2000)]
    df = spark.createDataFrame(boxes, "slide_id int, element_id int, element_type string, x double, y double, width double, height double")
    apart = lambda a, b: a[3] + a[5] <= b[3] or b[3] + b[5] <= a[3] or a[4] + a[6] <= b[4] or b[4] + b[6] <= a[4]
    own = [b for b in boxes if b[2] != "footer" and b[3] is not None and b[0] != 10]
    want = {(a[0], a[1], b[1]) for a in own for b in own if a[0] == b[0] and a[1] < b[1] and not apart(a, b)}
    got = [tuple(x) for x in overlaps(df).collect()]
    assert len(got) == len(set(got)) and {g for g in got if g[0] != 10} == want and len(want) > 50
    assert {g for g in got if g[0] == 10} == {(10, i, i + 1) for i in range(1999)}
    assert overlaps(df.limit(0)).count() == 0
