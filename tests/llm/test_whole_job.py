"""Operators do the whole job: no row, language or label is lost to a bound."""

import random

from textloom.llm import language_id, ngram_join, quality


# near duplicates where ids repeat or are null


def survivors(spark, rows):
    d = spark.createDataFrame(rows, "lang string, doc_id bigint, text string")
    kept = ngram_join.one_of_each(d)
    assert kept.columns == d.columns
    return sorted(((r.doc_id, r.text, r.lang) for r in kept.collect()), key=str)


def test_one_of_each_with_repeated_and_null_ids(spark):
    # two groups under one id: both keep a row
    assert [(i, t) for i, t, _ in survivors(spark, [("a", 1, "a b c d"), ("b", 1, "x y z q"), ("c", 2, "X y z q")])] == [(1, "a b c d"), (1, "x y z q")]
    # a row of id 5 is a copy of id 3, another row of id 5 stands alone
    assert survivors(spark, [("a", 3, "a b c d"), ("b", 5, "a b c d"), ("c", 5, "x y z q")]) == [(3, "a b c d", "a"), (5, "x y z q", "c")]
    # null ids: different texts all stay, of copies one, with a named row before an unnamed one
    got = survivors(spark, [("a", None, "k l m n"), ("b", None, "p q r s"), ("c", None, "p q r s"), ("d", None, None), ("e", None, "a b c d"), ("f", 9, "a b c d")])
    assert [(i, t) for i, t, _ in got] == sorted([(None, "k l m n"), (None, "p q r s"), (None, None), (9, "a b c d")], key=str) and (9, "a b c d", "f") in got


# quality rules for languages with few documents


def clean(letters, i, n=60):
    """A text of n words, drawn from 50."""
    r = random.Random(i)
    return " ".join(letters[(k := r.randrange(50)) % 12] + letters[k // 12] + letters[k % 7] * 3 for _ in range(n)) + "."


LATIN, GREEK, RUSSIAN = "etaoinshrdlu", "αβγδεζηθικλμ", "абвгдежзиклм"


def test_rare_languages_keep_clean_documents(spark):
    # the 70 languages are beyond the old cap of 64; the Greek and Russian ones have too few documents for a reference
    rows = [(f"l{k}", clean(LATIN, i)) for k in range(70) for i in range(20)] + [("zz", clean(RUSSIAN, i)) for i in range(20)]
    few = [("el", clean(GREEK, i)) for i in range(19)] + [("ru", clean(RUSSIAN, i)) for i in range(7)] + [(None, clean(GREEK, 3))]
    rows += few + [("ru", "а б")]
    d = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id bigint, lang string, text string")
    assert len(quality.references(d, quality.QualityParams())) == 71
    got = quality.quality_report(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert [(r.lang, r.n_words) for r in got if not r.kept] == [("ru", 2)]
    assert all((r.class_distance is None) == (r.lang in (None, "el", "ru")) for r in got)


# language identification with many languages


def test_every_labelled_language_is_fitted(spark):
    names = [f"q{chr(97 + k)}" for k in range(20)]
    letters = [chr(0x4E00 + 12 * k) + chr(0x4E01 + 12 * k) for k in range(20)]
    rows = [(k * 30 + i, " ".join([letters[k], letters[k][::-1]] * 10), names[k]) for k in range(20) for i in range(25 - k)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == names
    page = '<html lang="{}"><body><p>{}</p></body></html>'
    pages = [(k, f"http://h{k}.example/", page.format(names[k], letters[k] * 3)) for k in range(20)]
    pages += [(20, "http://p.example/", page.format(names[19], "12")), (21, "http://p.example/", page.format("xx", letters[18]))]
    got = {r.page_id: (r.language, r.declared) for r in language_id.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string"), model).collect()}
    assert got == {k: (names[k], names[k]) for k in range(20)} | {20: (names[19], names[19]), 21: (names[18], "xx")}
