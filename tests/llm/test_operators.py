"""Each corpus operator against a plain version, and on nulls, empty and long texts, ties, repeated rows,
empty tables and columns whose names clash with its own."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.llm import components, decontaminate, fixity, lm_score, mixing, near_dedup, packing, token_counts, top_k, toxicity, url_rules
from tributary.llm.common import MARK_WORDS, hot_map, salted_join, settle, words_of
from tributary.llm.queries import RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, id string, row string, size string, h string"


def docs_of(spark, rows):
    """Documents (id, text, source), with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", "y", "z", "w") for i, t, s in rows], DOCS)


def some_text(r, n, words=60):
    return " ".join(r.choice(["", "W", "Ä"]) + "w%d" % r.randrange(words) + r.choice(["", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(11)
    rows = [(i, some_text(r, r.randrange(1, 80)), r.choice(["a", "b", "c", "d", None])) for i in range(40)]
    rows += [(100, None, "a"), (101, "", "b"), (102, " \n\t", None), (None, "null id text w1 w2 w3", "a"), (None, None, None), (103, some_text(r, 30_000), "c"), (104, "x" * 200_000, "d")]
    rows += [rows[0], rows[0], rows[5], (7, some_text(r, 12), "a")]  # repeated rows, and an id with another text
    return rows


# Language-model scores.


def plain_scores(rows):
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _, _ in rows]
    counts, pairs, starts = Counter(), Counter(), 0
    for (_, t, _), h in zip(rows, held):
        if not h:
            own = lower(t)
            counts.update(own)
            pairs.update(zip(["<start>", *own], own))
            starts += 1
    n, v = sum(counts.values()), len(counts)
    # The power of counts that makes followers sum to the number of distinct pairs, and the quantised counts, both made here anew.
    low, high = 0.0, 1.0
    while high - low > 1e-12:
        power = (low + high) / 2
        low, high = (power, high) if sum(c**power for c in counts.values()) < len(pairs) else (low, power)
    power, least = (low + high) / 2, [1]
    while least[-1] < 10**6:
        least.append(max(least[-1] + 1, round(least[-1] * 1.25)))

    def quantised(c):
        at = sum(x <= c for x in least)
        return (least[at - 1] + least[at] - 1) / 2 if at else 0

    out = []
    for (i, t, _), h in zip(rows, held):
        own = lower(t)
        p0 = [(counts[w] + 0.5) / (n + 0.5 * (v + 1)) for w in own]
        score = 0.0
        for a, b, p in zip(["<start>", *own], own, p0):
            c = starts if a == "<start>" else counts[a]
            score += math.log10((min(quantised(pairs[a, b]), c, counts[b]) + c**power * p) / (c + c**power) if c else p)
        out.append((i, h, len(own), sum(counts[w] > 0 for w in own), n, sum(map(math.log10, p0)), score))
    return out


@pytest.mark.parametrize("max_broadcast", [lm_score.MAX_BROADCAST, 0])
def test_lm_scores(spark, odd_rows, max_broadcast, monkeypatch):
    monkeypatch.setattr(lm_score, "SEGMENT_WORDS", 300)
    monkeypatch.setattr(lm_score, "SEGMENT_PAIRS", 500)
    monkeypatch.setattr(lm_score, "PART_TOKENS", 700)
    got = sorted((tuple(r) for r in lm_score.lm_scores(docs_of(spark, odd_rows).repartition(3), max_broadcast=max_broadcast).collect()), key=repr)
    want = sorted(plain_scores(odd_rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert g[6] == pytest.approx(w[6], rel=0.03, abs=0.5)  # false positives of the filter, 2 in 100 probes


def test_lm_scores_without_rows(spark):
    assert lm_score.lm_scores(docs_of(spark, [])).count() == 0
    held = next(i for i in range(50) if lm_score.held_out(i))
    row = lm_score.lm_scores(docs_of(spark, [(held, "a b", "s")])).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (True, 3, 0, 0, 0.0, 0.0)


def test_filter_levels():
    r = np.random.default_rng(0)
    pairs = np.unique(r.integers(0, 1 << 40, 20_000).astype(np.uint64))
    counts = r.zipf(1.5, len(pairs)).clip(1, 10**6)
    bits = lm_score.build_filter(pairs, counts)
    own = np.frombuffer(bits, np.uint8)
    got = lm_score.read_levels(own, pairs, 8 * len(own))
    want = np.searchsorted(lm_score.LEAST, counts, side="right")
    assert (got >= want).all() and (got == want).mean() > 0.97  # one-sided
    other = np.setdiff1d(r.integers(0, 1 << 40, 20_000).astype(np.uint64), pairs)
    assert (lm_score.read_levels(own, other, 8 * len(own)) > 0).mean() < 0.03
    assert len(bits) * 8 <= lm_score.BITS_PER_ENTRY * want.sum() + 64
    assert list(lm_score.MEANT[:5]) == [0, 1, 2, 3, 4]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**40 - 1), max_size=50))
def test_packed_numbers(values):
    own = np.array(values, np.uint64)
    assert (lm_score.unpack40(lm_score.pack40(own)) == own).all()
    tokens = (own % np.uint64(2**31)).astype(np.int32)
    assert (lm_score.unpack_tokens(lm_score.pack_tokens(tokens)) == tokens).all()


# Top k.


def plain_top(vectors, queries, k, scale=256):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(scale * x) for x in v]
    out = []
    for q, v in {(q, tuple(v)) for q, v in queries if q is not None and ok(v)}:
        own = [(-sum(a * b for a, b in zip(whole(v), whole(c))), i) for i, c in vectors if i is not None and ok(c) and i != q and len(c) == len(v)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(own)[:k])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"block": 5, "stage_bytes": 1500}, {"seeds": 0, "pivots": 0}, {"seeds": 40, "pivots": 3}])
def test_top_k(spark, options):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1 + i % 3) for _ in range(8)]) for i in range(300)]
    rows += [(400 + i, list(rows[i][1])) for i in range(40)]  # ties
    rows += [(500, None), (501, [None, *rows[0][1][:7]]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, rows[0][1]), (504, []), (505, [0.5, 0.5]), (506, [0.0] * 8), rows[3], rows[3]]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, id string, score string")
    narrow = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    asked = df.filter(F.col("vec_id") % 20 == 0)
    got = sorted(tuple(x) for x in top_k.top_k(df.repartition(3), asked, k=5, **options).collect())
    assert got == plain_top(narrow, [x for x in narrow if x[0] is not None and x[0] % 20 == 0], 5)


def test_top_k_of_huge_components(spark):
    """Products beyond 64 bits are exact in the ranking; a score beyond a long is shown as the nearest."""
    r = random.Random(7)
    sizes = [1.0, 4e6, 1e9, 1e17, 1e200]
    rows = [(i, [r.choice([-1, 1]) * r.random() * sizes[i % 5] for _ in range(4)]) for i in range(60)] + [(100, [1.7e308] * 4), (101, [1e-300] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in top_k.top_k(df, df.filter("vec_id % 5 < 4"), k=4).collect())
    finite = [(i, v) for i, v in rows if all(math.isfinite(256 * x) for x in v)]
    want = plain_top(finite, [x for x in finite if x[0] % 5 < 4], 4)
    assert got == [(q, n, i, max(-(2**63), min(2**63 - 1, s))) for q, n, i, s in want]
    assert any(abs(s) > 2**70 for *_, s in want)


def test_top_k_prunes_and_stays_exact():
    """Clustered vectors: bounds spare most products, and nothing is lost."""
    r = np.random.default_rng(3)
    centres = r.normal(0, 400, (30, 16))
    vectors = np.floor(centres[r.integers(0, 30, 4000)] + r.normal(0, 12, (4000, 16)))
    queries, ids, pivots = vectors[:20], np.arange(4000), vectors[::130]
    best, squares = top_k.Best([None] * 20, 5), top_k.squares_of(vectors)
    table, to = top_k.distances(vectors, pivots), top_k.distances(queries, pivots)
    reach = float(np.sqrt(top_k.squares_of(pivots).max()))
    parts = [slice(a, a + 1000) for a in range(0, 4000, 1000)]
    taken = sum(top_k.search_table(best, ids[:20], queries, to, ids[p], vectors[p], squares[p], table[p], reach) for p in parts)
    for q in range(20):
        scores = vectors @ queries[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:5]
        assert [i for _, i in best.rows[q]] == order
    assert taken < 0.5 * 20 * 4000
    floors = top_k.first_floors(ids[:20], queries, ids[500:900], vectors[500:900], 5)
    assert all(f <= -best.rows[q][-1][0] for q, f in enumerate(floors))


def test_top_k_scans_vectors_once_a_stage(spark, monkeypatch):
    """The pivot table is made once, and each stage of queries reads it by one scan."""
    made = []
    monkeypatch.setattr(top_k, "settle", lambda df, name, *codec: made.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or settle(df, name, *codec))
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    top_k.top_k(df, df, block=50, stage_bytes=2000).count()
    names = [n for n, _ in made]
    assert names[:2] == ["pivot_table", "queries"] and len(names) >= 3 and set(names[2:]) == {"stage_of_queries"}
    assert all(p.count("Relation") == 1 and "Union" not in p for _, p in made[2:])


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k.top_k(df, df).count() == 0


# Toxicity.


def labelled(n, seed=0):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{r.randrange(300)}" for _ in range(r.randrange(5, 60))]
        bad, mild = r.random() < 0.3, r.random() < 0.3
        if mild:
            words += [r.choice(["meh", "dull"])] * 2
        if bad:
            words += [r.choice(["vile", "rotten", "nastyone", "nastytwo"]) for _ in range(2)]
        r.shuffle(words)
        docs.append((i, " ".join(words), "s"))
        labels.append((i, int(mild), int(bad)))
    return docs, labels


def test_toxicity(spark, odd_rows):
    rows, labels = labelled(600)
    known = spark.createDataFrame([*labels[:400], (1000, None, 1), (None, 1, 1), labels[0], (5, None, None)], "doc_id long, mild int, toxic int")
    docs = docs_of(spark, rows + [(1000 + i, t, s) for i, (_, t, s) in enumerate(odd_rows)])
    chain = toxicity.fit(docs, known, ("mild", "toxic"))
    got = toxicity.score(docs, chain, ("mild", "toxic"), keep=["doc_id"]).select("row.doc_id", "p.mild", "p.toxic").collect()
    assert len(got) == len(rows) + len(odd_rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] < 600}
    held = labels[400:]
    assert np.mean([(by[i]["toxic"] >= chain.threshold) == bool(bad) for i, _, bad in held]) > 0.98
    assert np.mean([(by[i]["mild"] >= 0.5) == bool(mild) for i, mild, _ in held]) > 0.97
    assert all(0 <= r["toxic"] <= 1 for r in got)
    new = toxicity.score(docs_of(spark, [(1, "NASTYTHREE things, nastythree", "s"), (2, None, "s"), (3, "fine words here", "s")]), chain, ("mild", "toxic")).select("row.*", "p.toxic").collect()
    found = {r["doc_id"]: r["toxic"] for r in new}
    assert found[1] >= chain.threshold > max(found[2], found[3])  # by the beginning of the word


def test_chain_like_a_plain_one(spark):
    """A chain fitted here by gradient descent on words, earlier probabilities out of fold, decides alike on documents that neither has seen."""
    rows, labels = labelled(700, 3)
    chain = toxicity.fit(docs_of(spark, rows), spark.createDataFrame(labels[:500], "doc_id long, mild int, toxic int"), ("mild", "toxic"))
    got = {r["doc_id"]: (r["mild"], r["toxic"]) for r in toxicity.score(docs_of(spark, rows), chain, ("mild", "toxic")).select("row.doc_id", "p.mild", "p.toxic").collect()}
    words = {w: i for i, w in enumerate(sorted({w for _, t, _ in rows for w in t.split()}))}
    x = np.zeros((700, len(words)))
    for i, (_, t, _) in enumerate(rows):
        x[i, [words[w] for w in t.split()]] = 1
    y = np.array([l[1:] for l in labels], float)

    def descend(x, y):
        w, b = np.zeros(x.shape[1]), 0.0
        for _ in range(400):
            e = 1 / (1 + np.exp(-(x @ w + b))) - y
            w, b = w - 0.5 * (x.T @ e / len(y) * 20 + 0.01 * w), b - 0.5 * e.mean() * 20
        return lambda z: 1 / (1 + np.exp(-(z @ w + b)))

    fold = np.arange(500) % 5
    first = descend(x[:500], y[:500, 0])
    unseen = np.zeros(500)
    for k in range(5):
        unseen[fold == k] = descend(x[:500][fold != k], y[:500][fold != k, 0])(x[:500][fold == k])
    second = descend(np.hstack([x[:500], unseen[:, None]]), y[:500, 1])
    mild = first(x[500:])
    toxic = second(np.hstack([x[500:], mild[:, None]]))
    ours = np.array([got[i] for i in range(500, 700)])
    assert np.mean((ours[:, 0] >= 0.5) == (mild >= 0.5)) > 0.96
    assert np.mean((ours[:, 1] >= chain.threshold) == (toxic >= 0.5)) > 0.93  # thresholds differ


def test_scorer_equals_chain():
    rows, labels = labelled(200, 1)
    sample = toxicity.Sample([t.encode() for _, t, _ in rows])
    chain = toxicity.Chain(sample, np.array([x[1:] for x in labels], float), np.arange(200) % 4)
    scorer = toxicity.Scorer(chain)
    own = np.zeros((200, 0))
    for link in chain.links:
        own = np.hstack([own, link.of_rows(np.arange(200), own)[:, None]])
    for i, (_, t, _) in enumerate(rows):
        assert scorer.probabilities(t.encode()) == pytest.approx(chain.probabilities(t.encode()))
        assert scorer.probabilities(t.encode()) == pytest.approx(own[i].tolist())
    assert len(chain.links[1].earlier) == 1


def test_earlier_probabilities_are_out_of_fold():
    """Labels at random: a model knows those that it was fitted on, but not those of its held-out fold."""
    r = random.Random(5)
    sample = toxicity.Sample([" ".join(f"f{r.randrange(40)}" for _ in range(6)).encode() for _ in range(300)])
    y = np.array([[r.randrange(2), r.randrange(2)] for _ in range(300)], float)
    chain = toxicity.Chain(sample, y, np.arange(300) % 4)
    inside = chain.links[0].of_rows(np.arange(300), np.zeros((300, 0)))
    assert np.corrcoef(inside, y[:, 0])[0, 1] > 0.3 > np.corrcoef(chain.unseen[:, 0], y[:, 0])[0, 1]


def test_threshold():
    p, y = np.array([0.001, 0.01, 0.2, 0.9]), np.array([0, 0, 1, 1.0])
    assert 0.01 < toxicity.best_threshold(p, y) < 0.2
    assert toxicity.best_threshold(np.array([0.3, 0.3]), np.array([0.0, 0.0])) == 0.5
    assert toxicity.best_threshold(np.array([0.3, 0.3, 0.3]), np.array([0.0, 0.0, 1.0])) > 0.3


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, [(1, "a b", "s"), (2, None, "s")])
    for known in ([], [(1, 1)]):
        chain = toxicity.fit(docs, spark.createDataFrame(known, "doc_id long, toxic int"), ("toxic",))
        got = toxicity.score(docs, chain, ("toxic",)).select("p.toxic").collect()
        assert len(got) == 2 and got[0] == got[1]
    assert toxicity.score(docs_of(spark, []), chain, ("toxic",)).count() == 0


# Near duplicates.


def plain_groups(rows, threshold=75, k=5):
    sets = []
    for i, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[j : j + min(k, len(words))]) for j in range(max(1, len(words) - k + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= threshold * (len(sets[a]) + len(sets[b]) - same):
                parent[find(a)] = find(b)
    by_id = defaultdict(set)
    for n, (i, _, _) in enumerate(rows):
        by_id[i].add(n)
    groups = defaultdict(list)
    for n, (i, _, _) in enumerate(rows):
        groups[find(n)].append(i)
    out = []
    for n, (i, _, _) in enumerate(rows):
        known = [x for x in groups[find(n)] if x is not None]
        c = min(known) if known and sets[n] else i
        out.append((i, len(sets[n]), c, c == i))
    return sorted(out, key=repr)


def altered(r, words, n):
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        words[at] = f"new{r.randrange(10**6)}"
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed, odd_rows):
    """Copies, chains of copies whose ends differ, a hub of many copies, a shared passage, very short texts."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = list(odd_rows)
    for g in range(12):
        words = [f"g{g}x{r.randrange(500)}" for _ in range(r.randrange(20, 150))]
        rows.append((200 + 100 * g, " ".join(words), "s"))
        for c in range(r.randrange(1, 9)):
            words = altered(r, words, max(1, len(words) // 60))
            rows.append((201 + 100 * g + c, " ".join(words).upper(), "s"))
    hub = [f"hub{i}" for i in range(200)]
    rows += [(3000 + i, " ".join(altered(r, hub, 4 + i % 3)), "s") for i in range(60)] + [(3100, " ".join(hub), "s")]
    rows += [(4000 + i, " ".join(passage + [f"q{r.randrange(10**6)}" for _ in range(r.randrange(10, 90))]), "s") for i in range(60)]
    rows += [(5000 + i, t, "s") for i, t in enumerate(["a", "A", "a b", "a b c d", "a b c d e", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h i j"])]
    got = sorted((tuple(x) for x in near_dedup.near_duplicates(docs_of(spark, rows).repartition(4)).collect()), key=repr)
    assert got == plain_groups(rows)


def test_stars_alone_would_miss_links(spark):
    """A chain in one bucket: the ends are unlike the centre, whichever it is."""
    words = [f"c{i}" for i in range(100)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60]), "s") for i in range(10)]
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert {x["component_id"] for x in got} == {0}


def test_ids_of_any_type(spark):
    import datetime
    import decimal

    texts = ["a b c d e f g", "A B C D E F G", "other words of no copy at all"]
    for kind, ids in (("string", ["x", "y", "z"]), ("decimal(20,0)", [decimal.Decimal(10**18 + i) for i in range(3)]), ("date", [datetime.date(2024, 1, 1 + i) for i in range(3)]), ("smallint", [1, 2, 3])):
        df = spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string")
        assert sorted(tuple(x) for x in near_dedup.near_duplicates(df).collect()) == [(ids[0], 3, ids[0], True), (ids[1], 3, ids[0], False), (ids[2], 3, ids[2], True)]
        assert {x["doc_id"] for x in lm_score.lm_scores(df).collect()} == set(ids)
        import public_tokenizers as P

        packed = packing.pack(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, length=64).collect()
        assert {i for x in packed for i in x["doc_ids"]} == set(ids)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(docs_of(spark, [])).count() == 0
    got = near_dedup.near_duplicates(docs_of(spark, [(1, None, "s"), (2, "", "s"), (3, " ", "s")])).collect()
    assert sorted(tuple(x) for x in got) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_parity_bounds_differences(a, b):
    one, two = (near_dedup.parity(np.array(sorted(x), np.uint64)) for x in (a, a | b))
    assert int(np.bitwise_count((one ^ two).view(np.uint64)).sum()) <= len((a | b) - a)


def test_bins_estimate_similarity():
    r = np.random.default_rng(1)
    walk = near_dedup.walks()
    for n, share in ((8, 0.75), (200, 0.6), (3000, 0.9)):
        equal = []
        for _ in range(150):
            base = r.integers(0, 2**64, 2 * n, dtype=np.uint64)
            same = int(n * share)
            a, b = np.unique(base[:n]), np.unique(np.concatenate([base[:same], base[n : 2 * n - same]]))
            want = same / (2 * n - same)
            equal.append((near_dedup.signature(a, walk) == near_dedup.signature(b, walk)).mean() - want)
        assert abs(np.mean(equal)) < 0.03, (n, share)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 90)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_hub_is_dealt_over_tasks(spark):
    """Where a key with very many rows meets its one row of another table, no task has much more rows than others."""
    n = 40_000
    edges = settle(spark.range(1, n).selectExpr("0L AS u", "id AS v"), "test_edges")
    least = settle(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "test_least")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = salted_join(edges, least.drop("c"), "u", hot_map(least.filter("c > 20000"), "u"), "v")
        tasks = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(tasks) == n - 1 and max(tasks) < 3 * n / 4 / 1.2 and len(tasks) == 4
        assert met.filter("m = 1").count() == n - 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


# Mixing.


def plain_mix(rows, weights=(5, 2, 1), share=1.5, cap=2.0, seed="mix"):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    total = {s: sum(n for n, (_, _, x) in zip(size, rows) if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, free = {s: 0.0 for s in sources}, list(sources)
    left = share * sum(size)
    while free:  # reshare what is above
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level >= cap * total[s]]
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        for s in full:
            target[s] = cap * total[s]
            left -= target[s]
            free.remove(s)
    return size, total, target


def test_mixing(spark, odd_rows):
    r = random.Random(6)
    rows = odd_rows + [(1000 + i, "w " * r.randrange(40), r.choice("aaaaaaabcdefg")) for i in range(600)]
    size, total, target = plain_mix(rows)
    found = mixing.mix(docs_of(spark, rows).repartition(3)).collect()
    assert len(found) == len(rows)
    assert Counter((x["doc_id"], x["size"], x["source"]) for x in found) == Counter((i, n, s) for (i, _, s), n in zip(rows, size))
    taken, most = Counter(), Counter()
    for x in found:
        assert x["source_size"] == total[x["source"]] and x["target"] == pytest.approx(target[x["source"]])
        assert x["taken"] <= 2 * x["size"] and (not x["size"] or x["taken"] % x["size"] == 0)
        taken[x["source"]] += x["taken"]
        most[x["source"]] = max(most[x["source"]], x["size"])
    repeats = Counter((i, t) for i, t, _ in rows)
    for s in total:
        own = max([n * repeats[i, t] for (i, t, x), n in zip(rows, size) if x == s], default=0)  # copies of an id go together
        assert abs(taken[s] - target[s]) <= own / 2 + 1e-6, s
    again = mixing.mix(docs_of(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    out = mixing.repeat(docs_of(spark, rows))
    assert out.columns == docs_of(spark, []).columns
    assert Counter(x["doc_id"] for x in out.collect()) == Counter(x["doc_id"] for x in found for _ in range(x["copies"]))


def test_thresholds_are_nested(spark):
    rows = [(i, "w " * (i % 17), "a" if i % 3 else "b") for i in range(500)]
    kept = []
    for share in (0.2, 0.5, 0.9):
        kept.append({x["doc_id"] for x in mixing.mix(docs_of(spark, rows), share=share).collect() if x["copies"]})
    assert kept[0] <= kept[1] <= kept[2]


def test_mixing_nothing(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    got = mixing.mix(docs_of(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert {(x["size"], x["taken"], x["target"]) for x in got} == {(0, 0, 0.0)}


# Token counts.


def test_token_counts(spark, odd_rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(8)
    rows = odd_rows + [(2000 + i, "".join(r.choice(" \n\tabcthe▁éñ😀.,'0123<>/sxyzß日本\x00") for _ in range(r.randrange(300))), "s") for i in range(300)]
    rows += [(3000, "</s><s><unk> <0x0A>", "s"), (3001, "▁▁ ▁", "s"), (3002, " " * 1000, "s"), (3003, "word " * 6000, "s")]
    got = token_counts.count_tokens(docs_of(spark, rows).repartition(3), tokenizer_path("piece_bpe_32k.model")).collect()
    want = Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, _ in rows)
    assert Counter(tuple(x) for x in got) == want
    assert token_counts.count_tokens(docs_of(spark, []), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_counts_survive_forgetting(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED_BYTES", 600)
    own = token_counts.PieceCounter(tokenizer_path("piece_bpe_32k.model"))
    text = "one two three four five one two three four five"
    assert own.count(text) == own.count(text) and 0 < len(own) <= 3


def test_texts_without_blanks_are_not_kept():
    """A unit as long as a document is counted, but the table of units stays small."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    own, r = token_counts.PieceCounter(tokenizer_path("piece_bpe_32k.model")), random.Random(4)
    for _ in range(20):
        text = "".join(r.choice("日本語中文字漢abcXYZ019+/=") for _ in range(5000))
        assert own.count(text) == len(model.encode(text))
    assert own.held < 10_000 and sum(map(len, own)) < 1000


# URL rules.


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest[len(host) : len(host) + 1] not in ("?", "#") else ""
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http:///x", "https://EXAMPLE.com/en/a", "http://www.example.com/en/?q#f", "http://a.www.example.com/en/x", "x://y://example.com/en/", "http://com", "http://com/",
    "http://notexample.com/en/1", "http://b.net/es/", "http://net/fr/x/", "http://b.net/fr", "http://b.net?x=/fr/", "http://b.net#/fr/", "http://user@b.net/es/a b", "http://..com//", "http://ÄB.com/en/é",
    "http://" + "a." * 2000 + "com/" + "y" * 5000, "http://b.org/en/", "HTTP://B.NET/FR/",
]


@pytest.mark.parametrize("more", [[], [("org", "", "block"), ("b.org", "/en", "block"), ("b.org", "/e", "allow"), ("com", "/", "block"), ("a.b.c.d.com", "/q/w", "allow")]])
@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_url_rules(spark, more, limit):
    rules = RULES + more
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, URLS[5], "h", "r"), (3, URLS[3], "h", "r"), (5, URLS[6], "h", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = Counter(tuple(x) for x in url_rules.judge(df, url_rules.rules_frame(spark, rules)).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == Counter((i, *plain_verdict(u, rules)) for i, u, _, _ in rows)


def test_url_rules_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(empty, url_rules.rules_frame(spark, RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert tuple(url_rules.judge(one, url_rules.rules_frame(spark, [])).first()) == (1, "a.com", "/x", None, "allow")


def test_url_rules_join_on_the_prefix_alone(spark, monkeypatch):
    """The join's only key is the short prefix; with prefixes that collide, digests still confirm and copies still count."""
    rows = [(i % 15, u) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    plan = url_rules.judge(df, url_rules.rules_frame(spark, RULES))._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert len(joins) == 1 and re.search(r"Join \[_prefix#\d+\], \[rule_prefix#\d+\]", joins[0])
    for digits in (0, 1):
        monkeypatch.setattr(url_rules, "PREFIX_DIGITS", digits)
        got = Counter(tuple(x) for x in url_rules.judge(df, url_rules.rules_frame(spark, RULES)).collect())
        assert got == Counter((i, *plain_verdict(u, RULES)) for i, u in rows)


def test_url_rules_run_no_python(spark):
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    plan = url_rules.judge(df, url_rules.rules_frame(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Fixity.


def records(spark, rows):
    df = spark.createDataFrame(rows, "archive string, position long, body string")
    return fixity.manifest(df, F.col("archive"), F.col("position"), F.col("body").cast("binary"))


def plain_audit(a, b):
    one, two = (defaultdict(Counter) for _ in range(2))
    for own, rows in ((one, a), (two, b)):
        for archive, at, body in rows:
            own[archive or "", -1 if at is None else at][body] += 1
    out = []
    for k in {*one, *two}:
        x, y = one[k] - two[k], two[k] - one[k]
        if x or y:
            many = sum(x.values()) > 1 or sum(y.values()) > 1
            out.append((*k, "conflict" if many else "missing" if not y else "extra" if not x else "changed"))
    return sorted(out)


def test_fixity(spark):
    r = random.Random(9)
    a = [(f"a{i % 3}", r.randrange(100_000) if i % 5 else i, f"body {i}" * r.randrange(4)) for i in range(400)]
    a += [("a0", None, "nowhere"), (None, 5, "no archive"), (None, None, "neither"), ("a1", -40, "below"), ("a2", 7, "twice"), ("a2", 7, "twice"), ("a2", 2**62, "far")]
    b = [(x, p, body + "!") if i % 50 == 3 else (x, p, body) for i, (x, p, body) in enumerate(a) if i % 70 != 9]
    b += [("a9", 1, "new archive"), ("a0", 123_456_789, "late"), ("a2", 7, "twice"), ("a1", -40, "second")]
    got = sorted((x["archive"], x["position"], x["status"]) for x in fixity.audit(records(spark, a), records(spark, b)).collect())
    assert got == plain_audit(a, b)
    assert fixity.audit(records(spark, a), records(spark, a[::-1])).count() == 0


def test_fixity_of_nothing(spark):
    none, some = records(spark, []), records(spark, [("a", 1, "x"), ("a", 99, "y")])
    assert fixity.audit(none, none).count() == 0
    assert {x["status"] for x in fixity.audit(some, none).collect()} == {"missing"}
    assert {x["status"] for x in fixity.audit(none, some).collect()} == {"extra"}


def test_roots_tell_any_change(spark):
    rows = [("a", i, f"r{i}") for i in range(300)]
    root = lambda own: fixity.root(fixity.tree(records(spark, own))).first()["root"]
    first = root(rows)
    assert root(rows[::-1]) == first
    assert len({first, root(rows[1:]), root([("a", 0, "other"), *rows[1:]]), root([*rows, rows[0]]), root([("b", 0, "r0"), *rows[1:]])}) == 5


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, tmp_path, compress):
    own = [("http://a/%d" % i, bytes(random.Random(i).randbytes(i * 37 % 5000))) for i in range(30)] + [("http://b/\r\n\r\n", b""), ("http://c", b"x\r\n\r\ny" * 50_000)]
    own[30] = ("http://b/", b"")
    data = fixity.write_warc(own, compress)
    (tmp_path / "x.warc").write_bytes(data)
    rows = sorted(fixity.read_warc(spark, str(tmp_path)).collect(), key=lambda r: r["offset"])
    assert [(r["target"], bytes(r["payload"])) for r in rows] == own
    assert sum(r["length"] for r in rows) == len(data) and all(r["type"] == "resource" for r in rows)
    assert [r["offset"] + r["length"] for r in rows[:-1]] == [r["offset"] for r in rows[1:]]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("seed", range(6))
def test_damaged_files_lose_nothing(compress, seed):
    """Flipped bits, cut ends and alien bytes: all bytes of a file are in some row, records away from the damage keep their place."""
    r = random.Random(seed)
    own = [("http://a/%d" % i, bytes(r.randbytes(r.randrange(2000)))) for i in range(20)]
    data = fixity.write_warc(own, compress)
    sound = {x[0]: x for x in fixity.parse_warc(data)}
    assert len(sound) == 20 and all(x[5] for x in sound.values())
    bad = bytearray(data)
    at = r.randrange(len(bad))
    if seed % 3 == 0:
        bad[at] ^= 1 << r.randrange(8)
    elif seed % 3 == 1:
        bad = bad[:at]
    else:
        bad[at : at + 40] = b"?" * 40
    rows = fixity.parse_warc(bytes(bad))
    assert sum(x[1] for x in rows) == len(bad) and [x[0] + x[1] for x in rows[:-1]] == [x[0] for x in rows[1:]]
    for x in sound.values():
        if x[0] + x[1] <= at or (seed % 3 != 1 and x[0] > at + 40):
            assert x in rows


def test_bad_headers(spark, tmp_path):
    good = fixity.write_warc([("http://x", b"body")], False)
    parts = [good, good.replace(b"Length: 4", b"Length: x"), good, good.replace(b"WARC/1.1", b"WARC 1.1"), good, b"no record at all", b""]
    rows = fixity.parse_warc(b"".join(parts))
    assert [x[5] for x in rows] == [True, False, True, False, True, False]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc").write_bytes(b"")
    got = sorted(((r["offset"], r["sound"]) for r in fixity.read_warc(spark, str(tmp_path)).collect()))
    assert got == [(x[0], x[5]) for x in rows]


# Packing.


def encoded(text):
    import public_tokenizers as P

    return packing.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode_ordinary(text or "") + [50256]


def test_packing(spark, odd_rows):
    import public_tokenizers as P

    df = docs_of(spark, odd_rows).repartition(2)
    packed = packing.pack(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, length=256, shard_tokens=5000)
    got = defaultdict(list)
    used = 0
    for row in packed.collect():
        ids, positions = np.frombuffer(row["ids"], "<i4"), np.frombuffer(row["positions"], "<i4")
        cuts = row["cu_seqlens"]
        assert len(ids) == len(positions) == 256 and cuts[0] == 0 and cuts[-1] == row["n_tokens"] <= 256
        assert len(cuts) - 1 == len(row["doc_ids"]) == len(row["doc_starts"])
        assert (ids[cuts[-1] :] == 50256).all()
        for a, b, doc, start in zip(cuts, cuts[1:], row["doc_ids"], row["doc_starts"]):
            assert positions[a:b].tolist() == list(range(b - a))
            got[doc].append((start, tuple(ids[a:b].tolist())))
        used += row["n_tokens"]
    want = defaultdict(list)
    for i, t, _ in odd_rows:
        ids = encoded(t)
        want[i] += [(at, tuple(ids[at : at + 256])) for at in range(0, len(ids), 256)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert used > 0.9 * 256 * packed.count()
    back = packing.unpacked(packed, 256)
    assert sorted((r["start"], tuple(r["ids"])) for r in back.filter("doc_id = 103").collect()) == sorted(want[103])


def test_written_matrices(spark, tmp_path, odd_rows):
    import public_tokenizers as P

    packed = packing.pack(docs_of(spark, odd_rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, length=512)
    packing.write_packed(packed, str(tmp_path / "m"))
    again = spark.read.parquet(str(tmp_path / "m"))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, packed.collect()))
    assert packing.pack(docs_of(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit_decreasing(lengths):
    """The same rows as by trying all open rows."""
    got = packing.best_fit_decreasing(np.array(lengths, dtype=np.int64), 40)
    rooms, want = [], []
    for i in np.argsort(-np.array(lengths, dtype=np.int64), kind="stable").tolist():
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[i])
        else:
            rooms.append(40 - lengths[i])
    assert sorted(i for row in got for i in row) == list(range(len(lengths)))
    assert sorted(40 - sum(lengths[i] for i in row) for row in got) == sorted(rooms)
    assert all(sum(lengths[i] for i in row) <= 40 for row in got)
    del want


def test_ranks_file():
    import public_tokenizers as P

    text = "Some text, ünïcode 123 \n\n end"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    names = {v: k for k, v in ranks.items()}
    assert b"".join(names[i] for i in encoded(text)[:-1]) == text.encode()


# Decontamination.


def plain_hits(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = defaultdict(set)
    for i, t in items:
        own = words(t)
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            phrases[tuple(own[k : k + size])].add("" if i is None else str(i))
    out = []
    for i, t, _ in docs:
        own = words(t)
        hit, found = set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(own) - size + 1):
                if who := phrases.get(tuple(own[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= who
        spans = [k for k in sorted(hit) if k - 1 not in hit], [k + 1 for k in sorted(hit) if k + 1 not in hit]
        out.append((i, len(own), len(hit), tuple(sorted(found)), tuple(zip(*spans))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"shard_words": 50}, {"block_bytes": 120}])
def test_decontamination(spark, odd_rows, options):
    r = random.Random(12)
    items = [(i, some_text(r, r.randrange(12, 40), 400)) for i in range(20)]
    items += [(50, "Tiny item"), (51, "one"), (52, ""), (53, None), (54, "!!! ..."), (None, some_text(r, 15)), items[3], (55, items[4][1].upper()), (56, "ß é 日本 " * 6)]
    rows = list(odd_rows)
    for n in range(60):
        _, t = items[r.randrange(20)]
        words = t.split(" ")
        a = r.randrange(len(words))
        cut = " ".join(words[a : a + r.randrange(1, 30)])
        rows.append((500 + n, some_text(r, r.randrange(20)) + " " + cut + r.choice([" ", "\n", "; "]) + some_text(r, r.randrange(20)), "s"))
    rows += [(600, "ß é 日本 " * 20, "s"), (601, (items[0][1] + " ") * 40, "s"), (602, "a tiny ITEM, one", "s")] + [(700 + i, items[2][1], "s") for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_hits(docs_of(spark, rows).repartition(3), bench, **options)
    got = sorted(((x["row"]["doc_id"], x["hits"]["n_words"], x["hits"]["n_hit"], tuple(x["hits"]["items"]), tuple((s["first"], s["past"]) for s in x["hits"]["spans"])) for x in found.collect()), key=repr)
    assert got == plain_hits(rows, items)


def test_cut_texts(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "Before, it. " + item.upper() + "! After it.", "s"), (2, "clean  text,\n kept", "s"), (3, None, "s"), (4, item, "s"), (5, item + " x " + item, "s")]
    out = decontaminate.cleaned(decontaminate.find_hits(docs_of(spark, rows), bench, cut=True))
    assert out.columns == [*docs_of(spark, []).columns, "hits"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: "Before, it.  ! After it.", 2: "clean  text,\n kept", 3: None, 4: " ", 5: "  x  "}
    assert decontaminate.find_hits(docs_of(spark, []), bench).count() == 0
    none = decontaminate.find_hits(docs_of(spark, rows), bench.limit(0)).collect()
    assert all(x["hits"]["n_hit"] == 0 for x in none) and len(none) == 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), max_size=8))
def test_fm_index(text, phrases):
    index = decontaminate.FMIndex(np.array(text), 5, sample=3)
    for p in phrases:
        low, high = index.search(np.array([p]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert got == [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=200))
def test_wavelet_matrix(symbols):
    own = np.array(symbols, np.int64)
    matrix = decontaminate.WaveletMatrix(own, 13)
    at = np.arange(len(own))
    seen, before = matrix.at(at)
    assert seen.tolist() == symbols
    assert before.tolist() == [symbols[:i].count(s) for i, s in enumerate(symbols)]
    every = np.arange(len(own) + 1)
    for s in {*symbols, 0, 12}:
        assert matrix.rank(np.full(len(every), s), every).tolist() == [symbols[:i].count(s) for i in every]


def test_words():
    assert words_of(b"A-b_c1 \xc3\xa9X", MARK_WORDS) == [b"a", b"b", b"c1", "é".encode() + b"x"]
    assert words_of(b"\x0b\x0c\x1cA\x85 b") == [b"\x1ca\x85", b"b"]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
