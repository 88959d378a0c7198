"""The registered corpus queries on the smallest tables, against their SQL and library counts."""

from __future__ import annotations

import os
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.compare import database, differences
from tributary.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert differences(spark, database(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF) == ""


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_token_counts_are_those_of_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    want = {i: (len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in texts(spark).items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op6_token_counts(spark, SF).collect()} == want


def test_scores_by_plain_counts(spark):
    """Everything of op1 but the model's score is plain counting; that is better than the base for texts that it has learnt from."""
    import math
    import zlib

    lower = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))] + [None]
    own = {i: lower(t) for i, t in texts(spark).items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in own}
    counts = Counter(w for i, ws in own.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = queries.op1_lm_score(spark, SF).collect()
    assert len(rows) == len(own)
    for r in rows:
        ws = own[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] or r["score"] > base


def test_packing_by_a_plain_packer(spark):
    """Each row's ids and positions are those of its segments, all segments together are all tokens, and there are as many rows as best fit decreasing makes."""
    import hashlib

    import numpy as np
    import public_tokenizers as P
    import tiktoken

    from tributary.llm import packing

    encode = packing.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert isinstance(encode, tiktoken.Encoding)
    ids = {i: [*encode.encode_ordinary(t), 50256] for i, t in texts(spark).items()}
    rows, seen = queries.op9_packing(spark, SF).collect(), Counter()
    for r in rows:
        cuts = r["cu_seqlens"]
        own = [ids[d][s : s + b - a] for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], cuts, cuts[1:])]
        flat = [x for part in own for x in part]
        assert len(flat) == r["n_tokens"] == cuts[-1] <= 2048 and [len(x) for x in own] == [b - a for a, b in zip(cuts, cuts[1:])]
        pad = 2048 - len(flat)
        assert hashlib.sha256(np.array(flat + [50256] * pad, "<i4").tobytes()).hexdigest() == r["ids_sha256"]
        assert hashlib.sha256(np.array([x for part in own for x in range(len(part))] + [0] * pad, "<i4").tobytes()).hexdigest() == r["positions_sha256"]
        seen.update((d, s + k) for d, s, part in zip(r["doc_ids"], r["doc_starts"], own) for k in range(len(part)))
    assert seen == Counter((d, k) for d, x in ids.items() for k in range(len(x)))
    room = []
    for n in sorted((min(2048, len(x) - at) for x in ids.values() for at in range(0, len(x), 2048)), reverse=True):
        fits = [i for i, free in enumerate(room) if free >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(2048 - n)
    assert len(rows) == len(room)


def test_toxicity_decides_by_its_labels(spark):
    """Of labelled documents, most are decided as their labels say."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["toxic"] is not None}
    rows = queries.op3_toxicity(spark, SF).collect()
    assert len(rows) == len(texts(spark)) and all(0 <= r["p_toxic"] <= 1 and 0 <= r["p_quality"] <= 1 for r in rows)
    assert sum(r["toxic"] == bool(labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels) > 0.85 * len(labels)  # some labels are wrong


def test_fixity_finds_the_damage(spark, monkeypatch):
    """Many small archives, with copies over several of them: what the replica's bytes differ in is found, and nothing else."""
    from tributary.llm import fixity

    monkeypatch.setattr(fixity.write_archives, "__defaults__", (20_000,))
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(fixity.record_text(F.col("url"), F.col("html")).alias("r"))
    copies = pages.limit(1).crossJoin(spark.range(300)).select("r")
    path = fixity.write_archives(pages.unionByName(copies))
    files = {p.parent.name.split("=")[1]: p.read_bytes() for p in Path(path).glob("archive=*/part-*")}
    assert len(files) > 20 and all(len(d) > 0 for d in files.values())
    written = Counter(x[4] for d in files.values() for x in fixity.parse_warc(d))
    assert written == Counter(r["html"].encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()) + Counter({copies.first()["r"].split("\r\n\r\n", 1)[1].encode(): 300})
    assert sum("-" in name for name in files) > 10  # the copies are more than an archive
    got = {(r["archive"], r["position"]): r["status"] for r in fixity.audit(
        fixity.fixity_manifest(fixity.read_warc(spark, path)), fixity.fixity_manifest(fixity.read_warc(spark, path, change=queries.damaged))).collect()}
    want = {}
    for name, data in files.items():
        bad = queries.damaged(name, data)
        for o, n, *_ in fixity.parse_warc(data):
            if data[o : o + n] != bad[o : o + n]:
                want[name, o] = "damaged" if bad[o] != data[o] or len(bad) < o + n else "changed"
        if len(bad) > len(data):
            want[name, len(data)] = "extra"
    assert got == want and {"damaged", "extra"} <= set(want.values())


def test_archives_leave_no_shuffled_texts(spark):
    """Records are written in passes, whose shuffled texts go when a pass ends: not one of 8 MB is left beside the archives."""
    from tributary.llm import fixity

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return sum(files.apply(i).length() for i in range(files.length()) if files.apply(i).getName().startswith("shuffle_"))

    rows = spark.range(8000).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.sha2(F.concat("id", i.cast("string")), 256)), "").alias("r"))
    before = shuffled()
    path = fixity.write_archives(rows, 1 << 20)
    assert shuffled() - before < 1 << 20
    files = list(Path(path).glob("archive=*/part-*"))
    assert len(files) == len({f.parent for f in files}) == 8  # each archive is one file, of one pass
    assert sum(f.stat().st_size for f in files) == 8000 * (16 * 64 + len(fixity.END))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
