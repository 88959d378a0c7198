"""The pipeline's stages against plain versions, on a small corpus with planted cases."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import docs_of, encoded, plain_groups, plain_hits, plain_mix

TOXIC = ["vile", "rotten", "nasty", "foul"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    items = [(i, text(25)) for i in range(10)]
    rows, labels = [], []
    for i in range(500):
        words = text(r.randrange(20, 120))
        bad = i % 5 == 0
        if bad:
            words += " " + " ".join(r.sample(TOXIC, 3))
        rows.append((i, words, f"src{i % 4}" if i % 3 else "src0"))
        if i < 400:
            labels.append((i, i % 2, int(bad)))
    rows += [(1000 + i, rows[5 * i + 1][1] + (" extra" if i % 2 else ""), "src1") for i in range(40)]  # copies
    rows += [(2000 + i, text(15) + "\n" + items[i][1][: 60 + 5 * i] + "\n" + text(10), "src2") for i in range(10)]  # leaks
    rows += [rows[6], rows[6], (3000, None, None), (3001, "", "src9"), (None, text(30), "src1"), (None, None, None)]
    folder = tmp_path_factory.mktemp("corpus")
    docs_of(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, items


def kept(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


def test_stages(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, folder).cache()
    assert clean.columns == docs.columns
    bad = lambda t: bool(t) and any(w in t.split() for w in TOXIC)
    assert Counter(kept(clean)) == Counter(x for x in rows if not bad(x[1]))

    once = stage["near_duplicates"](spark, clean, folder).cache()
    assert once.columns == docs.columns
    before, groups = kept(clean), plain_groups(kept(clean))
    good = {i for i, _, _, keep in groups if keep and i is not None}
    want = Counter(set(x for x in before if x[0] in good)) + Counter(x for x in before if x[0] is None)
    assert Counter(kept(once)) == want

    cut = stage["decontamination"](spark, once, folder).cache()
    assert cut.columns == docs.columns
    hits = {h[0]: h[2] for h in plain_hits(kept(once), items)}
    assert sum(n > 0 for n in hits.values()) >= 8
    own = {x[0]: x[1] for x in kept(cut)}
    for i, t, _ in kept(once):
        if i is not None:
            assert own[i] == t if not hits[i] else len(own[i].split()) == len(t.split()) - hits[i]
    assert all(h[2] == 0 for h in plain_hits(kept(cut), items))
    assert cut.filter("n_chars != length(coalesce(text, ''))").count() == 0

    mixed = stage["mixing"](spark, cut, folder).cache()
    assert mixed.columns == docs.columns
    size, _, target = plain_mix(kept(cut))
    taken = Counter()
    for i, t, s in kept(mixed):
        taken[s] += len((t or "").split())
    for s in target:
        assert abs(taken[s] - target[s]) <= 120, s

    packed = stage["packing"](spark, mixed, folder).collect()
    ids = Counter()
    for row in packed:
        flat, cuts = np.frombuffer(row["ids"], "<i4"), row["cu_seqlens"]
        for a, b, doc, start in zip(cuts, cuts[1:], row["doc_ids"], row["doc_starts"]):
            ids[doc, start, tuple(flat[a:b].tolist())] += 1
    assert ids == Counter((i, at, tuple(e[at : at + 2048])) for i, t, _ in kept(mixed) for e in [encoded(t)] for at in range(0, len(e), 2048))


def test_copies_under_a_shared_id(spark):
    """An id with three unlike texts, of which one is a copy of a document of smaller id: only that row goes."""
    r = random.Random(5)
    one, two, three = (" ".join(f"w{r.randrange(900)}" for _ in range(60)) for _ in range(3))
    rows = [(1, one, "a"), (2, one, "a"), (2, two, "a"), (2, two, "a"), (2, three, "a"), (2, None, "a"), (3, two + " more", "a"), (None, one, "a")]
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs_of(spark, rows).repartition(3), "")
    assert Counter(kept(out)) == Counter([(1, one, "a"), (2, two, "a"), (2, three, "a"), (2, None, "a"), (None, one, "a")])


def test_run(spark, corpus):
    folder = corpus[0]
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and "ids" in out.columns
    found = {x for r in out.select("doc_ids").collect() for x in r["doc_ids"]}
    assert not found & set(range(0, 500, 5)) and len(found) > 300


def test_empty_corpus(spark, tmp_path):
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert docs_of(spark, []).select(F.col("text")).count() == 0
