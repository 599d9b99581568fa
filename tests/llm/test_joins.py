"""Jaccard join, components, decontamination and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from barquet.llm import decontaminate, jaccard_join
from barquet.llm.common import importable
from barquet.llm.components import components


def sets_of(rows, size):
    out = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        out[doc_id] = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    return out


def brute_components(rows, size, num, den):
    sets = sets_of(rows, size)
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


def mutated(rng, words, changes, vocabulary):
    words = list(words)
    for _ in range(changes):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            words.insert(at, rng.choice(vocabulary))
        elif len(words) > 3:
            del words[at]
    return words


def groups(seed, n):
    """Texts of all lengths with exact copies and near copies around the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    common = [rng.choice(vocabulary) for _ in range(30)]
    while len(rows) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 4, 5, 8, 9, 10, 12, 14, 16, 17, 18, 20, 25, 40, 90)))]
        if rng.random() < 0.2:
            words = words + common
        for _ in range(rng.randint(1, 5)):
            w = mutated(rng, words, rng.choice((0, 0, 1, 1, 2, 4)), vocabulary)
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.1 else "  ".join(w)))
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows += [(len(rows) + i, " ".join(mutated(rng, base, rng.choice((1, 1, 2)), vocabulary))) for i in range(60)]
    return rows + [(-5, None), (-4, ""), (-3, " \n"), (-2, "w1"), (-1, "W1")]


@pytest.mark.parametrize("size,num,den,seed", [(4, 85, 100, 1), (5, 80, 100, 2)])
def test_join_equals_brute_force(spark, size, num, den, seed):
    importable(spark)
    rows = groups(seed, 330)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, size, num, den).collect()}
    assert got == brute_components(rows, size, num, den)


@pytest.mark.parametrize("boundary", [1, 20])
def test_boundary_does_not_change_links(spark, monkeypatch, boundary):
    importable(spark)
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *a: boundary)
    rows = groups(4, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_join_of_odd_rows(spark):
    importable(spark)
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None), (2, "a b c d e"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(jaccard_join.join(df).collect(), key=str)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter(
        [(1, 1), (1, 1), (None, None), (None, None), (2, 1), (3, 3)]
    )
    assert jaccard_join.join(df.limit(0)).count() == 0


def shared_id_rows():
    rng = random.Random(8)
    a, b = ([rng.choice("abcdefghijklmnopq") + str(rng.randrange(99)) for _ in range(60)] for _ in range(2))
    a, b, near = " ".join(a), " ".join(b), " ".join(b[:-1] + ["other"])
    return [(5, a), (7, a), (7, b), (9, near), (8, ""), (8, ""), (8, a), (None, a), (None, b)]


def test_texts_that_share_an_id(spark):
    importable(spark)
    df = spark.createDataFrame(shared_id_rows(), "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.join(df).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (8, 5), (None, None)}


def test_stage_keeps_different_texts_of_one_id(spark):
    rows = shared_id_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row_number string")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    want = [rows[0], rows[2], (8, ""), rows[7], rows[8]]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)


@pytest.mark.parametrize("most", [10**6, 0])
def test_partners_of_a_node_are_bounded(spark, monkeypatch, most):
    importable(spark)
    monkeypatch.setattr(jaccard_join, "WANTED_BYTES", 64 * most)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 4, raising=False)
    monkeypatch.setattr(jaccard_join, "ROWS_A_COPY", 2, raising=False)
    seen = []
    broadcast = jaccard_join.checked_broadcast
    monkeypatch.setattr(jaccard_join, "checked_broadcast", lambda t, *a: seen.append(t.dtypes) or broadcast(t, *a))
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(mutated(rng, base, i % 9, base))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = [(i, 0) for i in range(1, 90)] + [(89, i) for i in range(1, 89)]
    sets = sets_of(rows, 4)
    want = Counter((a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    links = jaccard_join.verified(docs, spark.createDataFrame(pairs, "a long, b long"), 4, 85, 100)
    assert Counter((r.a, r.b) for r in links.collect()) == want and 10 < len(want) < len(pairs)
    assert not any(kind.startswith("array") for t in seen for _, kind in t)


@pytest.mark.parametrize("n,m,both", [(1, 1, 1), (1, 900, 0), (40, 44, 40), (300, 300, 150), (5000, 4000, 1000)])
def test_prints_bound_the_overlap(n, m, both):
    rng = np.random.default_rng(n + m)
    drawn = rng.integers(0, 2**64, n + m - both, dtype=np.uint64)
    x, y = np.sort(drawn[:n]), np.sort(drawn[n - both :])
    raw = [jaccard_join.set_print(v) for v in (x, y)]
    s, t, most = jaccard_join.most_shared(*raw)
    assert (s, t) == (n, m) and both <= most <= both + 0.08 * (min(n, m) - both) + 3
    assert len(raw[0]) <= 1.2 * n + 1 or n == 1


@pytest.mark.parametrize("at_most", [1 << 20, 8])
def test_marks_keep_every_entry_of_a_list(spark, at_most):
    importable(spark)
    rng = np.random.default_rng(1)
    rows = [(i, i % 3 or None, rng.integers(-(2**63), 2**63, i % 7).tolist()) for i in range(200)]
    lists = {h for i, _, p in rows for h in p[:2] if i % 5 == 0}
    k, words = jaccard_join.list_marks(spark.createDataFrame([(h,) for h in lists], "h long"), at_most)
    assert words.nbytes <= at_most
    nodes = spark.createDataFrame(rows, "node long, hub long, prefix array<long>").repartition(3)
    got = Counter((r.node, r.hub, r.at, r.h) for r in jaccard_join.marked_entries(nodes, k, words).collect())
    every = Counter((i, hub, at, h) for i, hub, p in rows for at, h in enumerate(p))
    want = Counter({e: c for e, c in every.items() if e[3] in lists})
    assert not want - got and not got - every
    assert at_most == 8 or sum((got - want).values()) < 0.12 * sum(every.values())


def test_prints_refute_pairs_before_whole_sets_move(spark, monkeypatch):
    """Texts that share half of their words meet in lists; only pairs that may link go on, and all links stay."""
    importable(spark)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(mutated(rng, base, 1 + i % 13, base))) for i in range(80)]
    tried = []
    verified = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda docs, pairs, *a: tried.extend(pairs.collect()) or verified(docs, pairs, *a))
    monkeypatch.setattr(jaccard_join, "hub_pairs", lambda bands, found: bands.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 4, 85, 100)
    sets = sets_of(rows, 4)
    near = [100 * len(sets[a] & sets[b]) >= 82 * len(sets[a] | sets[b]) for a, b in tried]
    assert tried and all(near)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.sampled_from([(85, 100), (80, 100), (1, 2), (1, 1)]))
def test_overlap_is_the_least_that_links(s, t, share):
    num, den = share
    o = jaccard_join.overlap(s, t, num, den)
    assert den * o >= num * (s + t - o) and den * (o - 1) < num * (s + t - o + 1)
    # Any partner overlaps by at least what the prefix presumes.
    if o <= min(s, t):
        assert o >= s - jaccard_join.prefix_length(s, num, den) + 1


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=30))
def test_hamming_index_finds_all_within_the_radius(value, flips):
    other = value
    for b in flips:
        other ^= 1 << b
    index = decontaminate.HammingIndex(np.array([value], np.uint64))
    found = index.candidates(np.array([other], np.uint64))
    assert (len(found[0]) == 1) == (len(flips) <= decontaminate.RADIUS)


def test_fingerprint_is_the_majority_of_votes():
    hashes = np.array([0b1100, 0b1010, 0b1001, 0b1001], np.uint64)
    votes = decontaminate.running_votes(hashes)
    (got,) = decontaminate.fingerprints(votes, np.array([0]), 4)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0) > 2
    assert got == np.packbits(bits).view(np.uint64)[0]


def leak_rows():
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 60)))) for i in range(40)]
    items += [(100, "too short"), (101, None), (102, ""), (None, " ".join(vocabulary[:20])), (103, items[0][1])]
    docs = []
    for i in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if i % 2:
            piece = items[i % 40][1].split()
            piece = mutated(rng, piece, rng.choice((0, 0, 1, 2, 3)), vocabulary)
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in piece] if i % 3 else piece
        docs.append((i, " ".join(words)))
    return docs + [(1000, None), (1001, ""), (1002, " ".join(vocabulary[:20]))], items


def test_leaks_equal_brute_force(spark):
    importable(spark)
    docs, items = leak_rows()
    want = {}
    for item_id, text in items:
        s = decontaminate.shingles(text).tolist()
        for doc_id, body in docs:
            d = decontaminate.shingles(body).tolist()
            windows = (Counter(d[i : i + len(s)]) for i in range(len(d) - len(s) + 1)) if s else ()
            best = max((decontaminate.similarity(w, Counter(s)) for w in windows), default=0)
            if best >= 0.8:
                want[doc_id, item_id] = best
    df = spark.createDataFrame([(*d, 0.1) for d in docs], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(df, bench).collect()}
    assert len(want) > 50 and got == want
    assert any(0.8 <= v < 0.95 for v in want.values())
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.find(df, bench.limit(0)).count() == decontaminate.find(df.limit(0), bench).count() == 0


def brute_leaks(text, item, least=0.8):
    """The best similarity of a window, which is the whole text if that is shorter."""
    d, s = decontaminate.shingles(text).tolist(), decontaminate.shingles(item).tolist()
    n = min(len(d), len(s))
    best = max((decontaminate.similarity(Counter(d[i : i + n]), Counter(s)) for i in range(len(d) - n + 1)), default=0) if n else 0
    return best if best >= least else None


def test_documents_shorter_than_an_item(spark):
    importable(spark)
    rng = random.Random(5)
    items = [(n, [f"v{rng.randrange(900)}" for _ in range(n)]) for n in (*range(5, 21), 60)]
    docs = []
    for _, words in items:
        for cut in (1, 2, 3):
            docs += [words[:-cut], words[cut:], words[: len(words) // 2] + words[len(words) // 2 + cut :]]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    items = [(i, " ".join(w)) for i, w in items]
    want = {(d, i): s for d, text in docs for i, item in items if (s := brute_leaks(text, item))}
    assert {60, 15} <= {i for _, i in want} and len(want) < len(docs)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(df, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_repetitive_leaks_equal_brute_force():
    rng = random.Random(6)
    fresh = iter(f"u{i}" for i in range(10**6))
    pairs = []
    for k in range(300):
        times = rng.choice((3, 5, 6, 10))
        plain = [next(fresh) for _ in range(8 * (times + 4) + rng.randrange(2, 12))]
        run = ["0"] * (times + 4)
        # A run on one side, as many fresh words on the other.
        ends = plain + run, plain + [next(fresh) for _ in run]
        item, piece = ends if k % 2 else ends[::-1]
        filler = [next(fresh) for _ in range(rng.randrange(30))]
        pairs.append((" ".join(item), " ".join(filler + piece + filler)))
    pairs += [("0 " * 40 + "a b c", "0 " * n + "a b c") for n in (10, 30, 38, 45, 200)]
    pairs += [("a b c d e f a b c d e f x", "z " * n + "a b c d e f a b c d e f") for n in range(4)]
    found = decontaminate.Items.build([(i, item) for i, (item, _) in enumerate(pairs)])
    leaked = 0
    for i, (item, text) in enumerate(pairs):
        got, want = found.leaks(text).get(i, (None,))[0], brute_leaks(text, item)
        assert got == want, (item, text)
        leaked += want is not None
    assert leaked > 200


def test_leaks_in_blocks_of_the_benchmark(spark, monkeypatch):
    importable(spark)
    docs, items = leak_rows()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontaminate.find(df, bench).collect(), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert sorted(decontaminate.find(df, bench).collect(), key=str) == whole
    assert decontaminate.clean(df, bench).count() == len(docs) - len({r.doc_id for r in whole})


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A data folder with planted junk, copies and leaks among clean documents."""
    importable(spark)
    rng = random.Random(9)
    base = ["the of and to in is was for on with".split(), "der die und das ist nicht mit von ein zu".split()]
    docs, labels = [], []

    def text(k, n=80):
        return " ".join(rng.choice(base[k]) + rng.choice(("", "er", "en", "ing", "est")) + rng.choice("abcdefgh") for _ in range(n))

    for i in range(300):
        docs.append((i, text(i % 2), ("en", "de")[i % 2], "s", 1, "extra"))
        labels.append((i, 1, 0))
    item = text(0, 40)
    for i in range(300, 360):
        docs.append((i, text(0).replace(" ", "*** "), "en", "s", 1, "extra"))
        labels.append((i, 0, 0))
    docs += [(400, docs[3][1], "de", "s", 1, "x"), (401, docs[5][1] + " tail", "de", "s", 1, "x"), (401, docs[5][1] + " tail", "de", "s", 1, "x"),
             (402, text(0) + " " + item + " " + text(0), "en", "s", 1, "x"), (403, None, None, None, None, None),
             (None, text(1), "de", "s", 1, "x"), (404, text(1), None, "s", 1, "x"), (404, docs[-1][1], "en", "s", 1, "x")]
    folder = tmp_path_factory.mktemp("small")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, node string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    clean = {*range(300)}
    gone = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, small)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        gone.append({r.doc_id for r in docs.collect()} - {r.doc_id for r in rows})
        docs = spark.createDataFrame(rows, docs.schema)
    assert gone[0] >= {*range(300, 360), 403} and gone[1] == set()
    assert gone[2] == {400, 401} and gone[3] == {402}
    left = Counter(r.doc_id for r in docs.collect())
    assert clean <= set(left) and left[None] == 1 and max(left.values()) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r.doc_id for r in packed.collect()} == set(left)


def test_pipeline_of_nothing(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
