"""The pipeline's language stage holds back what has no sure language."""

import random

import corpus_pipeline


def test_unsure_documents_go(spark):
    rng = random.Random(3)
    words = {"en": "the and with house water stone think this", "fr": "les une avec maison l'eau pierre où été"}
    text = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    rows = [(k, text(lang, 30), lang) for k, lang in enumerate(["en", "fr"] * 60)]
    rows += [(900 + k, f"{text('en', 15)} {text('fr', 15)}", None) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r[0] for r in corpus_pipeline.language(spark, docs, "").select("doc_id").collect()}
    assert set(range(120)) <= kept
    assert len(kept) < len(rows)
