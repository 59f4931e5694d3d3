"""Quality rules with a distribution-divergence verdict.

Base measures are counted over the whole text. The verdict compares two
histograms of a document with references of its language by Jensen-Shannon
distance (base 2, so 0 to 1):

* character classes (small letters and digits, capitals, other scripts' letters, white
  space, sentence marks, other marks, symbols), and
* common words: shares of the language's most frequent words, all other words in
  one further bin.

References are grouped aggregates over all documents of a language: for the classes
the median over documents of each class's share, from exact counts in steps of 1 / STEPS
(a minority of junk moves it little, and partitioning not at all), for words the summed counts. Every language of `min_reference_docs` documents or more has
its own; documents of a smaller or null language have too few of their kind to be judged by,
so the base rules alone decide. The broadcast grows with the number of such languages,
by classes + common words each.

Edge cases. Null or empty text: no words, base_failed (fewer than `min_words`),
kept false. A text shorter than `min_chars` or `min_judged_words` isn't judged by
divergence, since short histograms are noise: the base rules alone decide. Rows
are judged one by one, so repeated rows and ids give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import as_bytes, discard, map_arrow, written

SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES = SYMBOLS.encode()
_WHITE = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    common_words: int = 60
    min_reference_docs: int = 20
    min_chars: int = 120
    min_judged_words: int = 20
    max_class_distance: float = 0.17
    max_word_distance: float = 0.65


def _class_table() -> np.ndarray:
    """Class of each byte of UTF-8 text. Lead bytes of other scripts' letters count once, continuation bytes not at all (class 7)."""
    table = np.full(256, 5, np.int64)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("0") : ord("9") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[0xC2:] = 2
    table[list(_WHITE)] = 3
    table[list(b".,;:?'\"-()")] = 4
    table[list(_SYMBOL_BYTES)] = 6
    table[0x80:0xC0] = 7
    return table


CLASSES = 7
STEPS = 2000
_CLASS = _class_table()
_PAD = re.compile(rb"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$")


def class_histogram(data: bytes) -> np.ndarray:
    """Counts of the character classes; they sum to the text's code points."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return np.bincount(_CLASS, weights=counts, minlength=CLASSES + 1)[:CLASSES]


def word_forms(words: list[bytes]) -> Counter:
    """Counts of words, A-Z lower-cased and stripped of outer ASCII marks."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out[_PAD.sub(b"", w.lower()) if not w.isalpha() else w.lower()] += n
    out.pop(b"", None)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence, base 2; 0 if either is empty."""
    if p.sum() == 0 or q.sum() == 0:
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def repeated_words(words: list[bytes], window: int) -> int:
    """Words that lie in a window of `window` words found twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    # windows are named exactly: pairs of names become new names, window - 1 times
    name = x
    for k in range(1, window):
        pair = name[: n - k] * len(ids) + x[k:]
        name = np.unique(pair, return_inverse=True)[1]
    counts = np.bincount(name)
    at = np.flatnonzero(counts[name] > 1)
    if not len(at):
        return 0
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measures(data: bytes, window: int) -> tuple[int, int, int, int, int, list[bytes]]:
    words = data.split()
    joined = b"".join(words)
    chars = len(joined) - len(joined.translate(None, bytes(range(0x80, 0xC0)))) if not joined.isascii() else 0
    symbols = len(joined) - len(joined.translate(None, _SYMBOL_BYTES))
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), len(joined) - chars, symbols, dup, repeated_words(words, window), words


def references(docs: DataFrame, params: QualityParams) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """Per language: class histogram, index of its common words, word histogram (last bin: other words)."""
    langs = [r[0] for r in docs.where("lang is not null").groupBy("lang").count().where(F.col("count") >= params.min_reference_docs).collect()]
    known = set(langs)

    def count(batches):
        """One pass: words, and for each class how many documents have which share, in steps of 1 / STEPS."""
        for b in batches:
            found: Counter = Counter()
            for lang, data in zip(b.column("lang").to_pylist(), as_bytes(b.column("text")), strict=True):
                if lang not in known:
                    continue
                found.update({(lang, -1, w): n for w, n in word_forms(data.split()).items()})
                h = class_histogram(data)
                if h.sum() >= params.min_chars:
                    found.update((lang, i, b"%05d" % x) for i, x in enumerate((STEPS * h / h.sum()).astype(int).tolist()))
            rows = [(*k, n) for k, n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int8(), pa.binary(), pa.int64()))], ["key", "kind", "word", "n"])

    passed = map_arrow(docs.select("lang", "text"), count, "key string, kind tinyint, word binary, n bigint")
    counted = written(passed.groupBy("key", "kind", "word").agg(F.sum("n").alias("n")), "quality_counts")

    # exact medians: at most STEPS + 1 rows a language and class
    steps, of_class = counted.where("kind >= 0"), Window.partitionBy("key", "kind")
    upto = steps.withColumn("upto", F.sum("n").over(of_class.orderBy("word"))).withColumn("all", F.sum("n").over(of_class))
    medians = upto.where(2 * F.col("upto") >= F.col("all")).groupBy("key", "kind").agg(F.min("word").alias("word")).collect()
    per_key: dict = {}
    for r in medians:
        per_key.setdefault(r["key"], np.zeros(CLASSES))[r["kind"]] = (int(r["word"]) + 0.5) / STEPS

    # top words per language: per salt first, so that no window holds a language's vocabulary
    order = [F.desc("n"), F.asc("word")]
    top = counted.where("kind < 0").withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(64)))
    total = F.sum("n").over(Window.partitionBy("key", "salt"))
    top = top.withColumn("salt_total", total)
    for by in (["key", "salt"], ["key"]):
        top = top.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= params.common_words)
        if len(by) == 2:
            top = top.withColumn("key_total", F.sum(F.when(F.col("r") == 1, F.col("salt_total"))).over(Window.partitionBy("key")))
    rows = top.select("key", "word", "n", "key_total").collect()  # bounded: languages * common words
    discard(counted)

    common: dict = {}
    for r in rows:
        common.setdefault(r["key"], ({}, r["key_total"]))[0][bytes(r["word"])] = r["n"]
    return {lang: _reference(per_key.get(lang, np.zeros(CLASSES)), *common.get(lang, ({}, 0))) for lang in langs}


def _reference(classes: np.ndarray, words: dict[bytes, int], total: int):
    names = sorted(words, key=lambda w: (-words[w], w))
    hist = np.array([words[w] for w in names] + [total - sum(words.values())], float)
    return classes, {w: i for i, w in enumerate(names)}, hist


def judge(data: bytes, lang: str | None, refs: dict, params: QualityParams) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance."""
    n, chars, symbols, dup, repeat, words = measures(data, params.window)
    failed = n < params.min_words or 100 * repeat > params.max_repeat_percent * n
    class_d = word_d = None
    shares = class_histogram(data)
    if lang in refs and n >= params.min_judged_words and shares.sum() >= params.min_chars:
        forms = word_forms(words)
        classes, index, hist = refs[lang]
        own = np.zeros(len(hist))
        for w, k in forms.items():
            own[index.get(w, len(index))] += k
        class_d, word_d = js_distance(shares, classes), js_distance(own, hist)
    kept = not failed and not (class_d is not None and (class_d > params.max_class_distance or word_d > params.max_word_distance))
    return n, chars, symbols, dup, repeat, failed, kept, class_d, word_d


RESULT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, class_distance double, word_distance double"
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2


def quality_report(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): the measures and the verdict."""
    refs = docs.sparkSession.sparkContext.broadcast(references(docs, params))
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches):
        for b in batches:
            out = [judge(d, g, refs.value, params) for d, g in zip(as_bytes(b.column("text")), b.column("lang").to_pylist(), strict=True)]
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text", "lang"), run, f"doc_id {id_type}, {RESULT}")


def keep_good(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    refs = docs.sparkSession.sparkContext.broadcast(references(docs, params))

    def run(batches):
        for b in batches:
            good = [judge(d, g, refs.value, params)[6] for d, g in zip(as_bytes(b.column("text")), b.column("lang").to_pylist(), strict=True)]
            yield b.filter(pa.array(good, pa.bool_()))

    return map_arrow(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
