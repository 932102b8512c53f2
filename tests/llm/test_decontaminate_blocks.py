"""The size of a block of items doesn't change what decontamination finds."""

from __future__ import annotations

import random

import pytest

from cladeloom.llm import decontaminate

from .test_documents import frame, prose


@pytest.mark.parametrize("per_block", [3, 7])
def test_items_per_block_does_not_change_results(spark, per_block):
    rng = random.Random(3)
    common = prose(77, 12)
    items = [(i, f"{prose(200 + i, 14 + i)} {common}" if i % 2 else prose(200 + i, 20 + i)) for i in range(20)] + [(20, "only three words"), (21, ""), (22, None)]
    rows = []
    for d in range(80):
        words = prose(d, 40).split()
        item = items[d % 20][1].split()
        for _ in range(d % 3):
            item[rng.choice([0, 1, -2, -1])] = "other"
        at = rng.randrange(len(words))
        words[at:at] = item
        rows.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = frame(spark, rows)

    def found(n):
        return sorted((*tuple(r)[:4], round(r["similarity"], 9)) for r in decontaminate.contaminated(docs, bench, items_per_block=n).collect())

    want = found(2000)
    assert len([r for r in want if r[4] < 1]) >= 10
    assert found(per_block) == want
