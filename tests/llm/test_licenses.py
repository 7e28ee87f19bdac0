"""License scan: whole paragraphs, edits, missing beginnings, prose; odd rows."""

import random
import re

from common import frame

from gridfield.llm import licenses
from gridfield.llm.license_texts import PARAGRAPHS


def scanned(spark, rows):
    return {r["doc_id"]: r for r in licenses.scan(frame(spark, rows).repartition(3)).collect()}


def prose(rng, n):
    return " ".join(rng.choice("the of software license use code to any and warranty copy notice it is under provided".split()) for _ in range(n))


def test_paragraphs_and_edits(spark):
    rng, rows = random.Random(1), []
    for k, (_, text) in enumerate(PARAGRAPHS):
        w = re.findall("[0-9a-z]+", text.lower())
        cut = len(w) // 2
        rows.append((10 * k, prose(rng, 30) + "\n" + text.upper() + "\n" + prose(rng, 30)))
        if len(w) >= 30:
            rows.append((10 * k + 1, " ".join([*w[:cut], "so", "to", "say", *w[cut:]])))  # three words put in
            rows.append((10 * k + 2, " ".join(w[: cut - 2] + w[cut + 2 :])))  # four left out
            rows.append((10 * k + 3, " ".join(w[len(w) // 5 :])))  # without its beginning
            rows.append((10 * k + 4, " ".join(w[: len(w) // 3])))  # a third only
    rows += [(5000 + k, prose(rng, 300)) for k in range(20)]
    out = scanned(spark, rows)
    for k, (label, text) in enumerate(PARAGRAPHS):
        assert label in out[10 * k]["labels"].split(",") and out[10 * k]["score"] == 1
        if len(text.split()) >= 30:
            for edit in (1, 2, 3):
                assert label in out[10 * k + edit]["labels"].split(",") and out[10 * k + edit]["score"] >= 0.6
            assert label not in out[10 * k + 4]["labels"].split(",")
    assert all(out[5000 + k]["labels"] == "" and out[5000 + k]["score"] == 0 for k in range(20))


def test_base_against_brute_force(spark):
    rng = random.Random(2)
    pieces = ["GNU", "General", "public", "License", "apache", "license,", "CC", "BY", "cc-by", "MIT", "mit  license", "é", "gnu general public license", "x", "2.0", "\n", "Apache\tLicense"]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randint(0, 60)))) for i in range(200)]
    rows += [(None, "MIT License"), (None, None), (300, ""), (300, "cc by"), (301, " \n"), (302, "mit license " * 5000), (303, "É mit licenseé mit license")]
    out = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(frame(spark, rows)).collect())
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted((k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        want.append((str(i), len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert out == sorted(want, key=lambda r: tuple(map(str, r))) or sorted(map(str, out)) == sorted(map(str, want))
    assert licenses.scan(frame(spark, [])).count() == 0
