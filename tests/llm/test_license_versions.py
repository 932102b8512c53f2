"""Labels claim no version that a text does not name; notices of any length are templates."""

from __future__ import annotations

import random

from cladeloom.llm import license_scan


def _labels(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["labels"] for r in sorted(license_scan.scan(df, **kw).select("doc_id", "labels").collect())]


def test_versions(spark):
    texts = [
        "Licensed under the GNU General Public License.",
        "Licensed under the GNU Lesser General Public License version 2.1",
        "Licensed under the GNU General Public License version 1",
        "Licensed under the GNU Lesser General Public License version 3.",
        "This file is licensed under the GNU General Public License version 3, see below.",
    ]
    got = _labels(spark, texts)
    assert got[0] == "gpl" and got[1] == "gpl" and got[2] == "gpl"
    assert got[3] == "gpl,lgpl-3.0" and "gpl-3.0" in got[4].split(",") and "gpl-2.0" not in got[4].split(",")


def test_every_notice_meets_itself(spark):
    flat = [(label, t) for label, ts in license_scan.TEMPLATES.items() for t in ts]
    for (label, _), got in zip(flat, _labels(spark, [t for _, t in flat])):
        assert label in got.split(",")


def test_a_whole_license_text_is_a_template(spark):
    rng = random.Random(1)
    words = [rng.choice(["grant", "right", "work", "party", "claim", "term", "copy", "use", "fee", "notice"]) + str(rng.randrange(30)).replace("1", "x") for _ in range(900)]
    words = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words]
    some = [w if rng.random() > 0.05 else "changed" for w in words]
    texts = ["intro " * 500 + " ".join(some) + " outro" * 300, " ".join(words[:450]), "nothing here"]
    assert _labels(spark, texts, templates={"long": [" ".join(words)], "short": ["one two three"]}) == ["long", "", ""]
