"""Column functions over text. All stay in the JVM except normalize_unicode()."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dictionaries import CONCEPT_REWRITES, NAME_PARTICLES

# What Python's \w is, spelt so that every regex engine reads it alike.
WORD = r"\p{L}\p{N}_"
NOT_ALNUM = r"[^\p{L}\p{N}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def word_array(c: Column | str) -> Column:
    """Words between white space; empty for blank text."""
    t = squeeze(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_count(c: Column | str) -> Column:
    return F.size(word_array(c))


def count_of(c: Column | str, needle: str | Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    c = col(c)
    return F.floor((F.length(c) - F.length(F.replace(c, n, F.lit("")))) / F.length(n)).cast("int")


def alnum_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(col(c), NOT_ALNUM, ""))


def alnum_ratio(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.length(c) > 0, alnum_count(c) / F.length(c)).otherwise(F.lit(0.0))


def digit_count(c: Column | str) -> Column:
    c = col(c)
    return F.length(c) - F.length(F.translate(c, "0123456789", ""))


def is_valid_document(c: Column | str, min_words: int = 20, min_chars: int = 100) -> Column:
    """Enough words and characters, few '<', at least 70 % letters and digits."""
    c = col(c)
    enough = (F.length(F.trim(c)) >= min_chars) & (word_count(c) >= min_words)
    clean = count_of(c, "<") <= count_of(c, " ") / 10
    return F.coalesce(enough & clean & (alnum_count(c) >= 0.7 * F.length(c)), F.lit(False))


def html_unescape(c: Column | str) -> Column:
    """The named entities that text commonly holds; &amp; last."""
    out = col(c)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def clean_html(c: Column | str, unescape_first: bool = False) -> Column:
    """Text of HTML: scripts, styles, comments and tags go, entities are decoded, white space squeezed.

    unescape_first=True decodes before parsing, so escaped markup vanishes too.
    """
    t = html_unescape(c) if unescape_first else col(c)
    t = F.regexp_replace(t, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^<>]*>", " ")
    return squeeze(t if unescape_first else html_unescape(t))


def clean_text_or_null(c: Column | str, min_length: int = 50) -> Column:
    t = col(c)
    return F.when(F.length(t) >= min_length, t)


_FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def normalize_unicode(form: str = "NFC", controls: str = "space"):
    """An Arrow UDF: Unicode form, control characters to spaces or deleted, white space squeezed.

    controls='delete' with form='NFKD' joins the words on both sides of a line break.
    """
    if form not in _FORMS or controls not in ("space", "delete"):
        raise ValueError(f"unknown form {form} or controls {controls}")

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd

        def one(t):
            if t is None:
                return None
            t = unicodedata.normalize(form, t)
            if any(unicodedata.category(x)[0] == "C" for x in set(t)):
                t = "".join(("" if controls == "delete" else " ") if unicodedata.category(x)[0] == "C" else x for x in t)
            return re.sub(r"\s+", " ", t).strip()

        return pd.Series([one(t) for t in texts], index=texts.index)

    return run


def controls_to_space(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(col(c), r"\p{Cntrl}", " "))


def fold_accents(c: Column | str) -> Column:
    """Latin letters without their accents; both cases."""
    return F.translate(col(c), "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN")


def vector_prep(c: Column | str, max_tokens: int = 384) -> Column:
    """Blank lines and spaces collapse, controls go, and text over 4 * max_tokens characters is cut with '...'."""
    t = F.regexp_replace(col(c), r"\n\s*\n", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    n = 4 * max_tokens
    return F.btrim(F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t), F.lit(" \t\n\r"))


def window_text(c: Column | str) -> Column:
    """Lower case; everything but word characters, white space and hyphens becomes a space; squeezed."""
    return squeeze(F.regexp_replace(F.lower(col(c)), rf"[^{WORD}\s-]", " "))


def normalize_concept(c: Column | str, longest_first: bool = True) -> Column:
    t = F.lower(squeeze(c))
    rules = sorted(CONCEPT_REWRITES, key=lambda r: -len(r[0])) if longest_first else CONCEPT_REWRITES
    for old, new in rules:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def concept_pattern(term: str) -> str:
    """A regex for a term: optional plural s per word; in words ending in l, l may be is. For Java and Python alike."""
    out = []
    for word in term.split():
        w = re.escape(word)
        if word.endswith("l"):
            out.append(w.replace("l", "(?:l|is)"))
        else:
            out.append(w + "s?")
    return rf"(?i)(?<![{WORD}])" + r"\s+".join(out) + rf"(?![{WORD}])"


def proper_name(c: Column | str) -> Column:
    """Each word capitalised except particles after the first word."""
    words = F.split(F.lower(squeeze(c)), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*NAME_PARTICLES), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))), " ")


def clean_section(c: Column | str) -> Column:
    """Three or more line breaks become two, blanks collapse, ruler lines and empty lines go."""
    t = F.regexp_replace(F.regexp_replace(col(c), r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^[_\-=*]{3,}$"))
    return F.array_join(lines, "\n")


def truncated(c: Column | str, n: int) -> Column:
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def process_number(c: Column | str, default: Column | None = None) -> Column:
    """A process number like 0001234-56.2023.8.18.0001, else the default."""
    got = F.regexp_extract(col(c), r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}", 0)
    return F.when(got != "", got).otherwise(default if default is not None else F.lit(None))


def first_match(c: Column | str, patterns: list[tuple[str, int]], cut: int = 200) -> Column:
    """The first pattern's group that matches, trimmed and cut; else null."""
    c = col(c)
    return F.coalesce(*(F.nullif(F.substring(F.trim(F.regexp_extract(c, p, g)), 1, cut), F.lit("")) for p, g in patterns))


def date_or_null(c: Column | str, form: str = "dd/MM/yyyy") -> Column:
    return F.try_to_date(col(c), form)


def hex_to_rgb(c: Column | str) -> Column:
    c = col(c)
    return F.struct(*(F.conv(F.substring(c, at, 2), 16, 10).cast("int").alias(n) for n, at in (("r", 2), ("g", 4), ("b", 6))))
