"""Quality rules, language identification, compression, extraction."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barquet.llm import compression, extract, language_id, quality_rules
from barquet.llm.common import importable

BLANK = r"[^\x20\x09-\x0D]+"
ODD = [None, "", "  \n ", "one", "a b c d e a b c d e a b c d e", "x\n\nx\nx \ny", "# * | <>&\n$%", "é Ü\u00a0z " * 40,
       "w " * 30_000, "\x0b\x0ca\tb", "a\nb\na\nb\n \n \n"]


def base(text):
    text = text or ""
    words = re.findall(BLANK, text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(BLANK, line):
            dup += line in lines
            lines.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_base_counts(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in quality_rules.statistics(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base(texts[r.doc_id]), texts[r.doc_id]


def test_rules_cover_the_bad_and_leave_the_good(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        words = [rng.choice("the of and to in is was for on with".split()) + rng.choice("abcdefgh") for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            words = [w + rng.choice(("***", "$$$")) if i % 2 else w.upper() for w in words]
        rows.append((i, " ".join(words), int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.select("doc_id", F.col("quality"), F.lit(0).alias("toxic"))
    docs = docs.drop("quality").withColumn("n_words", F.lit("clash")).withColumn("row", F.lit(1))
    judged = {r.doc_id: r.kept for r in quality_rules.apply(docs, labels).collect()}
    wrong = [i for i, _, q in rows if judged[i] != bool(q)]
    assert len(wrong) <= 9
    kept = quality_rules.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in judged.items() if k}


def test_rules_without_labels_are_empty(spark):
    docs = spark.createDataFrame([(1, "a " * 20), (2, None), (None, "b c d e f g h i j k l")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (7, 0), (None, 0)], "doc_id long, quality int")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.apply(docs, labels).collect()}
    assert got == {1: (True, False), 2: (True, False), None: (False, True)}
    assert quality_rules.apply(docs.limit(0), labels).count() == 0


SENTENCES = {
    "en": "the quick brown fox jumps over the lazy dog and then they were all together with this thing",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann waren sie alle zusammen mit dem ding",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et puis ils étaient tous ensemble avec cette chose",
    "es": "el rápido zorro marrón salta sobre el perro perezoso y luego estaban todos juntos con esta cosa",
}


def language_rows(n=160):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = list(SENTENCES)[i % 4]
        words = SENTENCES[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(25)), lang))
    return rows


def test_languages_are_told_apart(spark):
    importable(spark)
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.filter("doc_id < 100"), per_language=20)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert all(got[i][0] == lang and 0 <= got[i][1] <= 1 for i, _, lang in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %"), (4, "The dog " * 90_000)], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in language_id.predict(odd, model).collect()}
    assert found == {1: "und", 2: "und", 3: "und", 4: "en"}
    wide = odd.withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    kept = language_id.confident(wide, model, 0.2)
    assert kept.columns == wide.columns and [r.doc_id for r in kept.collect()] == [4]


def test_features_do_not_depend_on_parts(monkeypatch):
    text = "Ein Satz, über alles. " * 40
    whole = language_id.features(text)
    monkeypatch.setattr(language_id, "_PART", 37)
    assert abs(language_id.features(text) - whole).max() < 1e-9


def test_only_letters_are_letters():
    assert language_id.features("\U0001f600\U0001f680 12 \U0001f4a9!") is None
    assert (language_id.features("abc \U0001f600 d") == language_id.features("abc   d")).all()
    assert language_id.features("\U00010400\U00020000") is not None


def test_no_language_and_one_language(spark):
    importable(spark)
    docs = spark.createDataFrame([(1, "abc", None), (2, "x", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()} == {("und", 0.0)}
    one = language_id.train(docs.withColumn("lang", F.lit("tlh")))
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, one).collect()} == {("tlh", 1.0)}


def test_compression_tells_good_from_bad(spark):
    importable(spark)
    rng = random.Random(2)
    rows = []
    for i, text, lang in language_rows(400):
        bad = i % 3 == 0
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.filter("doc_id < 250").select("doc_id", "quality")
    model = compression.train(docs.drop("quality"), labels, per_class=60)
    got = {r.doc_id: r.score for r in compression.score(docs, model).collect()}
    wrong = [i for i, _, q in rows if i >= 250 and (got[i] >= 0.5) != bool(q)]
    assert len(wrong) <= 3 and all(0 <= s <= 1 for s in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 3_000_000), (3, "a")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in compression.score(odd, model).collect())
    assert compression.score(odd.limit(0), model).count() == 0
    assert rng


def test_compression_without_labels(spark):
    importable(spark)
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = compression.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in compression.score(docs, model).collect()} == {0.5}


PAGES = [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>unclosed <b>bold<p>two&nbsp;&amp; three", "unclosed bold two & three"),
    ("<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a href=/>x</a></nav><article><h1>H</h1>"
     "<p>One, two.<br>Three</p><!-- <p>no</p> --></article><footer>f</footer></body></html>", "H One, two. Three"),
    ("<div class='cookie-notice'>We use</div><main><div class=sidebar>s</div><p>Kept text, here.</p></main>", "Kept text, here."),
    ("<header><h1>Site</h1><p>x</p></header><article><header><h1>Head</h1><p>by</p></header><p>Body, of it.</p></article>", "Head Body, of it."),
    ("<article><p>Story, long, enough.</p></article><div id='comments'><p>First, one, two, three, four, five</p></div>", "Story, long, enough."),
    ("<ul><li><a href=1>a, b, c</a></li><li><a href=2>d, e, f</a></li></ul><div><p>Main part, with commas, and words.</p>"
     "<p>More of it.</p></div><form><input value=1>q</form>", "Main part, with commas, and words. More of it."),
    ("<article><p>a <script>x<y</script> b</p><style>p{}</style></article", "a b"),
    ("<p>broken <a href=\"x>tail", "broken tail"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("a < b <", "a < b <"),
    ("<p>x</p></div></article></p>y", "x y"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert extract.main_text(html) == text


BODY = "".join(f"<p>Long body text number {k}, with commas, and words enough to make a real paragraph.</p>" for k in range(6))


@pytest.mark.parametrize("html", [
    "<div class='content has-sidebar'>{}</div><div><p>Left over</p></div>",
    "<div class='no-sidebar'>{}</div>",
    "<div id='content-with-comments'>{}</div><div><p>Left over</p></div>",
    "<div class='toc-article'>{}</div><div><p>Left over</p></div>",
    "<div class='page sidebar'><div class=widget><article>{}</article></div></div><div><p>Left over</p></div>",
    "<article><div class='entry ad'>{}</div></article>",
    "<div><p class='notice'>Notice{}</div>",
    "<ul><li class='share'>Share</ul><div>{}</div>",
    "<table><tr><td class='sidebar'>Side<td>{}</table>",
    "<head><title>t</title><body><div>{}</div>",
    "<div>{}</div><div class='comments'>" + "<div class=comment><p>I think, as one does, that this is so.</p></div>" * 9 + "</div>",
])
def test_marked_elements_take_no_article_with_them(html):
    assert extract.main_text(html.format(BODY)) == extract.main_text(f"<article>{BODY}</article>")


def test_extract_keeps_rows(spark):
    importable(spark)
    rows = [(i, None, h, "t") for i, (h, _) in enumerate(PAGES)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract.extract(df).collect()
    assert len(got) == 2 * len(PAGES) and all(r.text == PAGES[r.page_id][1] for r in got)
    assert extract.extract(df.limit(0)).count() == 0


# ------------------------------------------------------------------ pages of odd shapes
BODY = "".join(f"<p>Paragraph {k} of the story, with commas, names, and enough words to be read as text by anyone.</p>" for k in range(6))


@pytest.mark.parametrize("page", [
    f'<html><body><div title="see hidden text">{BODY}</div><nav>Home About</nav></body></html>',
    f'<html><body><div class="page hidden lg-block">{BODY}</div></body></html>',
    f'<html><body><form action="/x"><div>{BODY}</div><input type="hidden" name="a"></form></body></html>',
    f'<html><body><aside><div>{BODY}</div></aside></body></html>',
])
def test_wrapped_pages_keep_their_text(page):
    text = extract.main_text(page)
    assert all(f"Paragraph {k} of" in text for k in range(6)) and "Home" not in text


def test_hidden_forms_and_asides_go_beside_an_article():
    page = (f"<html><body><article>{BODY}<p>where <math><mi>x</mi>=<mn>1</mn></math> holds.</p></article>"
            '<form><p>Subscribe, please, to the letter.</p></form><aside><p>Another story, elsewhere.</p></aside>'
            '<div hidden><p>unseen, one</p></div><div style="display: none"><p>unseen, two</p></div>'
            '<div aria-hidden="true"><p>unseen, three</p></div></body></html>')
    text = extract.main_text(page)
    assert "Paragraph 5" in text and "x=1" in text
    assert not any(w in text for w in ("Subscribe", "Another", "unseen"))


@pytest.mark.parametrize("page", [
    "<div><p>a, b" * 200_000, "</span>" * 300_000 + "<p>end of it, all", "<div class=ad>" * 200_000 + "<p>x, y",
    "<span>" * 200_000 + "<p>text, here</p>", "<div>" * 100_000 + "<li>x</li>" * 100_000,
    "<main>" * 100_000 + "<p>m, n", "<article><header>" * 60_000 + "<h1>t",
])
def test_megabytes_of_nested_elements_finish(page):
    assert isinstance(extract.main_text(page), str)


def plain_points(root):
    """Points by walking up from every paragraph."""
    points = {}

    def walk(node):
        inner = [x for x in node.items if isinstance(x, extract.Node)]
        if node.tag in extract.BLOCKS:
            leaf = not any(x.tag in extract.BLOCKS and not x.marked for x in inner)
            text = extract._own_text(node)
            if (node.tag in extract.PARAGRAPHS or leaf) and text:
                given, share = 1 + text.count(",") + min(len(text) // 100, 3), 1.0
                up = node.parent if (node.tag in extract.PARAGRAPHS or node.parent is None) and not node.marked else node
                level = 0
                while up is not None:
                    points[id(up)] = points.get(id(up), 0.0) + given * share
                    level += 1
                    share = 0.5 if level == 1 else share / 3
                    up = None if up.marked else up.parent
        for x in inner:
            walk(x)

    walk(root)
    return points


def test_points_equal_walks_up_random_trees():
    rng = random.Random(5)

    def tree(depth):
        parts = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "p", "section", "ul", "li", "span", "td", "div class=ad", "a"])
            inner = tree(depth - 1) if depth and rng.random() < 0.7 else "words, and more " * rng.randint(0, 12)
            parts.append(f"<{tag}>{inner}</{tag.split()[0]}>")
        return "".join(parts)

    for _ in range(60):
        root = extract.parse(tree(4))
        nodes = extract._order(root)
        scored = extract._score(nodes)
        want = plain_points(root)
        assert scored.keys() == want.keys()
        assert all(scored[k].points == pytest.approx(want[k]) for k in want)


# ------------------------------------------------------------------ samples of models
def test_samples_are_bounded_whatever_ids_repeat(spark):
    importable(spark)
    rows = [(1, f"text number {k} of one id", "en") for k in range(400)] + [(2, "same text", "de")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = language_id.training_rows(docs, 20)
    assert got.groupBy("lang").count().rdd.collectAsMap() == {"en": 20, "de": 1}
    assert language_id.training_rows(docs, 20, most=10).count() == 6
    labels = spark.createDataFrame([(1, 1)] * 50 + [(2, 0)] * 50, "doc_id long, quality int")
    spans = compression.training_rows(docs, labels, 30)
    assert {r.good: r["count"] for r in spans.groupBy("good").count().collect()} == {True: 30, False: 1}
