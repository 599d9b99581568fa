"""Token counts, periodic runs and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter as Tally

import pytest
from pyspark.sql import functions as F

from barquet.llm import periodic_runs, queries, spelling_variants, token_counts
from barquet.llm.common import importable
from barquet.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ token counts
ODD_TEXTS = [
    None, "", " ", "a", "A b\n\nc", "don't I'll  x y", "日本語 text", "<|endoftext|> hi<|endoftext|>", "a\x85b", "áb́c",
    "½ ²³ 12½", " \n \n", "\x1c a", "é'Sx 's", "word " * 5000, "a" * 6000, "ab" * 900, "😀😀 😀" * 200,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_counts_equal_the_library(library):
    rnd = random.Random(7)
    texts = [t or "" for t in ODD_TEXTS]
    texts += ["".join(rnd.choice("abct  \n<|>endofx'é日😀019_") for _ in range(rnd.randint(1, 600))) for _ in range(150)]
    texts += ["".join(rnd.choice(a) for _ in range(3000)) for a in ("ab", "abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/")]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.Counter(tokenizer_path()).count(texts) == want


def test_merging_orders_agree():
    """All pairs at once, the first pair only, and positions by rank leave the same symbols."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abe t") for _ in range(rnd.randint(2, 200))).encode() for _ in range(60)] + [b"a" * k for k in range(2, 20)]
    merger = token_counts.Merger(tokenizer_path())
    assert merger.ordered
    at_once = merger.counts(words).tolist()
    by_rank = [merger._long(merger._of_byte[list(w)]) for w in words]
    merger.ordered = False
    assert at_once == by_rank == merger.counts(words).tolist()


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.Merger(public_tokenizers.path("word_bpe_49k.json"))


def test_count_of_odd_rows(spark, library):
    importable(spark)
    rows = [(i, t, 1) for i, t in enumerate(ODD_TEXTS)] + [(None, "a b", 2), (3, "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = token_counts.count(docs, tokenizer_path(), limit=2).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts.count(docs.limit(0), tokenizer_path()).count() == 0


# ------------------------------------------------------------------ periodic runs
def plain_runs(words, least=12):
    """Stretches equal to themselves p words later, smallest p for the same ends."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        x = 0
        while x + p < n:
            start = x
            while x + p < n and words[x] == words[x + p]:
                x += 1
            if x + p - start >= max(least, 2 * p):
                found.setdefault((start, x + p), p)
            x += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def random_words(rnd):
    n, k = rnd.randint(0, 160), rnd.choice([1, 2, 2, 3, 5, 40])
    words = [rnd.randrange(k) for _ in range(n)]
    for _ in range(rnd.randint(0, 4)):
        if n > 3:
            a = rnd.randrange(n)
            p, z = rnd.randint(1, max(1, (n - a) // 2)), rnd.randint(a, n)
            for i in range(a + p, z):
                words[i] = words[i - p]
    return [str(w) for w in words]


def fibonacci(n):
    a, b = "0", "01"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_runs_equal_brute_force():
    rnd = random.Random(11)
    lists = [random_words(rnd) for _ in range(250)] + [fibonacci(900), ["a"] * 700, list("ababab" * 40 + "bababa" * 40)]
    for at in range(0, len(lists), 7):
        part = lists[at : at + 7]
        runs, _ = periodic_runs._batch([[w.encode() for w in words] for words in part], 12)
        for words, got in zip(part, runs):
            assert [(r["start"], r["length"], r["period"]) for r in got] == plain_runs(words)


def test_very_long_repetitive_text():
    runs, collapsed = periodic_runs._batch([[b"a"] * 200_000], 12)
    assert runs == [[{"start": 0, "length": 200_000, "period": 1}]] and collapsed == [b"a"]


def plain_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {x for s, length, p in runs for x in range(s + p, s + length)}
    best = min(((-length, s, p) for s, length, p in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for x, w in enumerate(words) if x not in gone)),
    )


def test_run_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 5000").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_periodic_runs"](spark, SF)
    kept = {d.doc_id for d in docs}
    rows = sorted(tuple(r) for r in got.collect() if r.doc_id in kept)
    assert rows == sorted(plain_row(d.doc_id, d.text) for d in docs)
    assert sum(r[1] > 0 for r in rows) > 10


def test_runs_of_odd_rows(spark):
    importable(spark)
    same = "x y z " * 9
    rows = [(1, None, "p"), (2, "", "q"), (3, " \t\n ", "r"), (4, same, "s"), (4, same, "s"), (None, same, "t"), (5, "a b " * 30, "u")]
    rows += [(k, "w%d " % k * 14 + same, "v") for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic_runs.digests(periodic_runs.find(queries.planted_repeats(docs), batch_words=50)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_row(i, t)) for i, t, _ in rows)
    assert periodic_runs.find(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ spelling variants
def plain_variants(rows, least_chars=6, least_count=5, share=5, planted=199):
    total = Tally()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            if doc_id is not None and planted:
                run = spelling_variants.changed(doc_id, run, planted)
            total[run] += 1
    n = {w: c for w, c in total.items() if len(w) >= least_chars and c >= least_count}
    near = {w: set() for w in n}
    for w in n:
        out = {w[:i] + w[i + 1 :] for i in range(len(w))}
        out |= {w[:i] + chr(c) + w[i + 1 :] for i in range(len(w)) for c in spelling_variants.ALPHABET}
        for other in out & n.keys() - {w}:
            near[w].add(other)
            near[other].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        if best is not None and n[best] >= share * n[w]:
            form[w] = best
    result = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        result.append((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(result)


@pytest.fixture(scope="module")
def misspelt():
    """Words with edits of edits, each rarer than what it comes from; accents and long words."""
    rnd = random.Random(4)
    letters = "abcdeé×÷ÿz"
    rows = []
    for k in range(12):
        word = "".join(rnd.choice(letters) for _ in range(rnd.choice([6, 7, 8, 70, 300])))
        level = [word]
        for n in (900, 150, 30, 6):
            rows += [(rnd.randrange(10**6), f"{w.upper() if k % 2 and w.isascii() else w}, " * n) for w in level]
            level = [e for w in level for e in (w[:2] + rnd.choice(letters) + w[3:], w[:4] + w[5:], w + "q")][:4]
    return rows + [(None, "nullkey " * 9), (3, None), (4, ""), (3, "nullkexy " * 9), (3, "nullkexy " * 50)]


@pytest.mark.parametrize("filter_bytes", [spelling_variants.FILTER_BYTES, 8 * 700])
def test_variants_equal_brute_force(spark, misspelt, filter_bytes):
    importable(spark)
    docs = spark.createDataFrame([(*r, "x") for r in misspelt], "doc_id long, text string, word string")
    got = spelling_variants.variants(docs, planted=199, filter_bytes=filter_bytes).collect()
    want = plain_variants(misspelt)
    assert sorted(map(tuple, got)) == want
    assert any(r[5] != r[3] and r[3] for r in want), "no chain in the fixture"


def test_variants_of_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op13_spelling_variants"](spark, SF).collect()
    want = plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, got)) == want and want


def test_variants_of_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants.variants(docs).count() == 0


def test_long_word_needs_little_more_than_itself(spark):
    """A hundred thousand letters generate millions of edits, of which none becomes a string."""
    importable(spark)
    word = "abcdefghij" * 10_000
    docs = spark.createDataFrame([(k, word) for k in range(6)] + [(9, word[:-1])], "doc_id long, text string")
    words = spelling_variants.vocabulary(docs, least_count=1)
    assert spelling_variants.near_pairs(words).count() == 1
