"""Language identification by Bayesian evidence fusion.

log P(language | page) = text + declared + host prior, where

* text is the log-likelihood of the page's words under character n-gram models
  (orders 1 to 3, with word ends), scaled so that it weighs as `text_weight` words at
  most: words of one page aren't independent;
* declared is P(declared markup language | language), estimated over all pages
  by a grouped aggregate of text posteriors and smoothed with the belief that a declaration is right;
* the host prior is smoothed hierarchically: all pages, then address suffix (the last
  label), then host. Each level is a grouped sum of text posteriors; a level's
  share is (own sum + strength * parent's share) / (own count + strength). The page's own
  posterior is taken out of the sums first, so it isn't evidence for itself.

The n-gram models are fitted for every labelled language on a bounded sample: `train_docs`
documents a language of at most `train_bytes` bytes each, chosen by a hash of the id. All
other counts cover all pages.

Edge cases. Null or empty html: no text evidence, so declaration and host prior decide.
Null or unparsable url: host and suffix empty, a group of their own. No or
unknown declaration: no such evidence; an unknown one is still reported. Ties go to the alphabetically first
language. Without labelled documents every language is null. Whole texts are scored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, as_texts, map_arrow, written
from .url_filter import host_of


@dataclass(frozen=True)
class Params:
    train_docs: int = 300
    train_bytes: int = 20_000
    text_weight: float = 40.0
    declared_trust: float = 0.9
    declared_strength: float = 20.0
    prior_strength: float = 10.0


_OPEN = re.compile(r"(?i)<(script|style|noscript|template)\b|<!--")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*+>") for name in ("script", "style", "noscript", "template")} | {"": re.compile("-->")}
_TAG = re.compile(r"<[^<>]*>")
_HTML = re.compile(r"(?i)<html\b")
_LANG = re.compile(r"(?i)\blang\s*+=\s*+[\"']?\s*+([a-z]{2,8})")
_WORD = re.compile(r"[^\W\d_]+")
WORD_ENTRIES = 300_000


def without_scripts(html: str) -> str:
    """html without scripts, styles and comments, from each opening to its nearest end. What is never closed stays; each kind is sought in vain once at most."""
    out, at, open_ended = [], 0, set()
    m = _OPEN.search(html)
    while m:
        name = (m[1] or "").lower()
        end = None if name in open_ended else _CLOSE[name].search(html, m.end())
        if end:
            out += [html[at : m.start()], " "]
            at = end.end()
        else:
            open_ended.add(name)
        m = _OPEN.search(html, end.end() if end else m.end())
    return "".join([*out, html[at:]])


def declared_language(html: str) -> str | None:
    """The lang of the first html tag that has one; each tag is read once."""
    m = _HTML.search(html)
    while m:
        end = html.find(">", m.end())
        end = len(html) if end < 0 else end
        if lang := _LANG.search(html, m.end(), end):
            return lang[1].lower()
        m = _HTML.search(html, end)
    return None


def page_text(html: str) -> str:
    return html_lib.unescape(_TAG.sub(" ", without_scripts(html)))


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)]


class TextModel:
    """Character n-gram log-likelihoods, one vector per gram."""

    def __init__(self, languages: list[str], counts: dict[str, Counter]):
        self.languages = languages
        vocabulary = set().union(*counts.values()) if counts else set()
        totals = np.zeros((3, len(languages)))
        kinds = Counter(len(g) for g in vocabulary)
        for j, lang in enumerate(languages):
            for g, n in counts[lang].items():
                totals[len(g) - 1, j] += n
        self.unseen = [np.log(0.5 / (totals[k] + 0.5 * (kinds[k + 1] + 1))) for k in range(3)]
        self.gram = {}
        for g in vocabulary:
            k = len(g) - 1
            self.gram[g] = np.log((np.array([counts[lang][g] for lang in languages]) + 0.5) / (totals[k] + 0.5 * (kinds[k + 1] + 1)))
        self.words: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        v = self.words.get(w)
        if v is None:
            gs = grams(w)
            v = sum((self.gram.get(g, self.unseen[len(g) - 1]) for g in gs), np.zeros(len(self.languages))) / len(gs) * 3
            if len(self.words) >= WORD_ENTRIES:
                self.words.clear()
            self.words[w] = v
        return v

    def text(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words, mean log-likelihood of a word per language."""
        counts = Counter(_WORD.findall(text.lower()))
        n = sum(counts.values())
        if not n:
            return 0, np.zeros(len(self.languages))
        return n, sum((k * self.word(w) for w, k in counts.items()), np.zeros(len(self.languages))) / n


def fit(labelled: DataFrame, params: Params = Params()) -> TextModel:
    """Fit on a bounded sample of labelled(doc_id, text, lang)."""
    from pyspark.sql import Window

    rows = labelled.where("lang is not null and text is not null")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    counts: dict[str, Counter] = {lang: Counter() for lang in langs}
    d = rows.where(F.octet_length("text") <= params.train_bytes)
    # distinct rows, the first by hash within salts, then overall: no window holds a language's documents
    key = F.xxhash64("doc_id", "text", F.lit(7))
    keys = d.select("lang", key.alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(64)))
    for by in (["lang", "salt"], ["lang"]):
        keys = keys.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= params.train_docs)
    chosen = F.broadcast(keys.select("lang", "h"))  # train_docs rows a language
    sample = d.withColumn("h", key).join(chosen, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    for lang, text in sample.select("lang", "text").toLocalIterator():
        for w, n in Counter(_WORD.findall(text.lower())).items():
            for g in grams(w):
                counts[lang][g] += n
    return TextModel(langs, counts)


def _softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(pages: DataFrame, model: TextModel, params: Params = Params()) -> DataFrame:
    """One row per row of pages(page_id, url, html): host, declared, n_words, text_language, language, confidence."""
    spark, langs = pages.sparkSession, model.languages
    n = len(langs)
    id_type = pages.schema["page_id"].dataType.simpleString()
    if not n:
        return pages.select("page_id", host_of(F.col("url")).alias("host"), *(F.lit(None).cast(t).alias(c) for c, t in (("declared", "string"), ("n_words", "bigint"), ("text_language", "string"), ("language", "string"), ("confidence", "double"))))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            declared, words, ll = [], [], []
            for page in as_texts(b.column("html")):
                declared.append(declared_language(page))
                k, v = m.text(page_text(page))
                words.append(k)
                ll.append((v * min(k, params.text_weight)).tolist())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), pa.array(declared, pa.string()), pa.array(words, pa.int64()), pa.array(ll, pa.list_(pa.float64()))], ["page_id", "host", "declared", "n_words", "ll"])

    scored = map_arrow(pages.select("page_id", host_of(F.col("url")).alias("host"), "html"), run, f"page_id {id_type}, host string, declared string, n_words bigint, ll array<double>")
    scored = scored.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("post", _softmax(F.col("ll")))
    # a page without text tells the sums nothing
    scored = written(scored.withColumn("w", (F.col("n_words") > 0).cast("double")), "scored")
    sums = [F.sum(F.col("w") * F.col("post")[i]).alias(f"s{i}") for i in range(n)]

    # one row: over all pages
    total = scored.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), *sums).first()
    all_share = [((total[f"s{i}"] or 0.0) + 1.0) / ((total["w"] or 0.0) + n) for i in range(n)]

    # declared given language: at most languages^2 cells
    known = spark.createDataFrame([(x,) for x in langs], "declared string")
    cells = {r["declared"]: r for r in scored.join(F.broadcast(known), "declared", "left_semi").groupBy("declared").agg(*sums).collect()}
    given = np.zeros((n, n))
    for i, lang in enumerate(langs):
        seen = np.array([(cells[d][f"s{i}"] or 0.0) if d in cells else 0.0 for d in langs])
        belief = np.array([params.declared_trust if d == lang else (1 - params.declared_trust) / max(1, n - 1) for d in langs])
        given[i] = (seen + params.declared_strength * belief) / (seen.sum() + params.declared_strength)
    said = np.log(np.maximum(given, 1e-12)).T.tolist()
    evidence = spark.createDataFrame(list(zip(langs, said, strict=True)), "declared string, said array<double>")

    a = params.prior_strength
    suffix = scored.groupBy("suffix").agg(F.sum("w").alias("sw"), *sums).select("suffix", "sw", F.array(*(f"s{i}" for i in range(n))).alias("ss"))
    hosts = scored.groupBy("suffix", "host").agg(F.sum("w").alias("hw"), *sums).select("suffix", "host", "hw", F.array(*(f"s{i}" for i in range(n))).alias("hs"))
    priors = hosts.join(suffix, "suffix").drop("suffix")
    priors = F.broadcast(priors) if priors.count() <= BROADCAST_ROWS // 10 else priors
    d = scored.join(priors, "host")

    share = F.array(*(F.lit(float(x)) for x in all_share))

    def prior(x: Column, i: Column) -> Column:
        own = F.col("w") * x
        at_suffix = (F.get("ss", i) - own + a * F.get(share, i)) / (F.col("sw") - F.col("w") + a)
        return F.log(F.greatest((F.get("hs", i) - own + a * at_suffix) / (F.col("hw") - F.col("w") + a), F.lit(1e-12)))

    d = d.withColumn("prior", F.transform("post", prior)).join(F.broadcast(evidence), "declared", "left")
    d = d.withColumn("said", F.coalesce("said", F.array_repeat(F.lit(0.0), n)))
    d = d.withColumn("total", _plus(_plus(F.col("ll"), F.col("prior")), F.col("said"))).withColumn("fused", _softmax(F.col("total")))
    names = F.array(*(F.lit(x) for x in langs))

    def best(v: Column) -> Column:
        return F.element_at(names, F.array_position(v, F.array_max(v)).cast("int"))

    return d.select("page_id", "host", "declared", "n_words", F.when(F.col("n_words") > 0, best(F.col("ll"))).alias("text_language"), best(F.col("total")).alias("language"), F.round(F.array_max("fused"), 6).alias("confidence"))
