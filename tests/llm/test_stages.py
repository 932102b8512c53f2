"""Every stage of the pipeline on one awkward table, against what each stage is to do."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from cladeloom.llm import quality

from .test_documents import brute_contaminated, brute_lines, check_packing, prose
from .test_near_dedup import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, row int, keep string, fp long, digest string, n int, raw string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "h", 1, "k", 2, "d", 3, "r") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    out = [(i, "\n".join(prose(1000 + 7 * i + k, 12) for k in range(6))) for i in range(60)]
    shared = prose(5, 14)
    out += [(60 + i, prose(2000 + i, 60) + "\n" + shared + "\n" + prose(2100 + i, 20)) for i in range(20)]
    for i in range(20):  # near copies of long lines
        words = out[i][1].replace("\n", " ").split()
        words[rng.randrange(len(words))] = "changed"
        out.append((100 + i, " ".join(words)))
        out.append((140 + i, " ".join(words[:-1])))
    out += [(200 + i, " ".join(f"{w}%%%" for w in prose(3000 + i, 60).split())) for i in range(25)]
    out += [(300 + i, prose(4000 + i, 40) + " " + prose(9000 + i % 3, 30) + " " + prose(4100 + i, 20)) for i in range(9)]
    # no id, no text, one id for two texts, rows that repeat
    out += [(None, prose(5000, 50)), (None, None), (400, None), (401, ""), (None, out[3][1]), (5, prose(5001, 50)), (7, out[7][1]), (402, "x " * 3000)]
    out += [(None, prose(5002, 40) + " " + prose(9001, 30) + " end")]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    labels = [(i, 1, 0) for i in range(160)] + [(200 + i, 0, 0) for i in range(25)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, prose(9000 + k, 30)) for k in range(3)], "item_id int, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_each_stage_does_its_work_on_an_awkward_table(spark, rows, folder):
    stage = dict(corpus_pipeline.STAGES)
    docs = table(spark, rows)

    kept = stage["quality"](spark, docs, folder)
    assert kept.schema == docs.schema
    scores = quality.score(docs, *quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert kept.count() == scores.filter("score >= 0.3").count()
    left = pairs(kept)
    assert not any("%%%" in (t or "") for _, t in left) and len({(i, t) for i, t in rows if i is not None and i < 160} - set(left)) <= 6

    # null ids sort first; rows that repeat an id and text fare alike
    named = [(i, t) for i, t in left if i is not None and i not in (5, 7) and t]
    cut = stage["line_dedup"](spark, table(spark, named), folder)
    fate = brute_lines(named)
    want = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in fate[i])) for i, t in named]
    assert pairs(cut) == sorted(want, key=repr) and any(fate.values())
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    assert len(pairs(stage["line_dedup"](spark, kept, folder))) == len(left)

    one = stage["simhash"](spark, kept, folder)
    assert one.schema == docs.schema
    sets = [shingles(t) for _, t in left]
    group = list(range(len(left)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(left)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(left):
        best[find(i)] = min(best.get(find(i), (True, 0)), (d is None, d or 0))
    got = pairs(one)
    assert len(got) == len(best) and sorted((d is None, d or 0) for d, _ in got) == sorted(best.values())
    assert set(got) <= set(left) and len(best) < len(left) - 30

    clean = stage["decontaminate"](spark, one, folder)
    assert clean.schema == docs.schema
    numbered = list(enumerate(t for _, t in got))
    gone = {d for d, *_ in brute_contaminated(numbered, [(k, prose(9000 + k, 30)) for k in range(3)])}
    assert pairs(clean) == sorted((got[k] for k, _ in numbered if k not in gone), key=repr) and len(gone) >= 9

    check_packing(pairs(clean), stage["packing"](spark, clean, folder).collect())


def test_run_is_its_stages_in_turn(spark, rows, folder):
    table(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    tokens = lambda df: sorted((repr(r["doc_id"]), r["doc_tokens"], r["length"]) for r in df.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).withColumnRenamed("sum(length)", "length").collect())
    assert tokens(corpus_pipeline.run(spark, folder)) == tokens(docs)
