"""Operators over raw web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

HREF = r"""href\s*=\s*["']([^"']*)["']"""


def links(pages: DataFrame, must_hold: tuple[str, ...]) -> DataFrame:
    """Distinct hrefs of each page that hold all given strings, in order; all hrefs if none does."""
    all_links = F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), 1))
    good = F.filter(all_links, lambda x: _holds(x, must_hold))
    return pages.select("page_id", F.when(F.size(good) > 0, good).otherwise(all_links).alias("links"))


def _holds(x: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & F.contains(x, F.lit(p))
    return out


def metadata(pages: DataFrame) -> DataFrame:
    """Title, language, first date, process number of each page by ordered patterns."""
    return pages.select(
        "page_id",
        tx.first_match("html", [(r"(?is)<title>(.*?)</title>", 1), (r"(?is)<h1>(.*?)</h1>", 1)]).alias("title"),
        tx.first_match("html", [(r"""(?i)<html[^>]*\blang\s*=\s*["']([A-Za-z-]+)["']""", 1)]).alias("lang"),
        tx.date_or_null(F.regexp_extract("html", r"\b(\d{2}/\d{2}/\d{4})\b", 1)).alias("published"),
        tx.process_number("html", F.concat(F.lit("processo_"), F.col("page_id").cast("string"))).alias("number"),
        F.md5("url").alias("url_hash"),
    )


def paragraphs(docs: DataFrame, min_chars: int = 100, at_most: int = 10, cut: int = 3000) -> DataFrame:
    """The first paragraphs over min_chars of each document, cut, with their ordinal."""
    p = F.slice(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > min_chars), 1, at_most)
    return docs.select("doc_id", F.posexplode(p).alias("i", "p")).select("doc_id", (F.col("i") + 1).alias("ordem"), F.substring("p", 1, cut).alias("content"))


# The fields of a process page, each with its patterns in order and the group that counts.
FIELD_PATTERNS = {
    "relator": ((r"relator:?\s*([^\n]+)", 1), (r"des\.?\s*([^\n]+)", 1), (r"desembargador\s+([^\n]+)", 1)),
    "orgao_julgador": ((r"câmara[^:]*:?\s*([^\n]+)", 1), (r"turma[^:]*:?\s*([^\n]+)", 1), (r"(\d+ª\s*câmara[^,\n]*)", 1)),
    "classe_judicial": ((r"classe:?\s*([^\n\(]+)", 0), (r"apelação\s+cível", 0), (r"agravo\s+de\s+instrumento", 0)),
    "data_publicacao": ((r"publicação:?\s*(\d{2}/\d{2}/\d{4})", 1), (r"data:?\s*(\d{2}/\d{2}/\d{4})", 1)),
    "autor": ((r"apelante:?\s*([^\n]+)", 1),),
    "reu": ((r"apelado:?\s*([^\n]+)", 1),),
}
SUBJECTS = (("empréstimo consignado", "Empréstimo Consignado"), ("consignado", "Consignado"))

# How each section of a decision begins; it goes on to an empty sentence or the end.
SECTION_HEADS = (
    ("ementa", r"ementa[:\s]*"),
    ("relatório", r"relatório[:\s]*"),
    ("voto", r"voto[:\s]*"),
    ("decisão", r"decisão[:\s]*"),
    ("fundamentos", r"(?:fundament|razões)[^:]*[:\s]*"),
    ("dispositivo", r"(?:diante|pelo)\s+exposto[^\.]*\."),
)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def process_fields(docs: DataFrame, patterns=FIELD_PATTERNS, subjects=SUBJECTS, cut: int = 200) -> DataFrame:
    """doc_id and the fields of docs(doc_id, text): of the first pattern that matches its group, stripped and cut; else null."""
    text, low = F.col("text"), F.lower("text")

    def field(ways) -> Column:
        return F.coalesce(*(F.when(text.rlike(f"(?iu){p}"), F.substring(_stripped(F.regexp_extract(text, f"(?iu){p}", group)), 1, cut)) for p, group in ways))

    subject = F.coalesce(*(F.when(F.contains(low, F.lit(word)), F.lit(name)) for word, name in subjects))
    return docs.select("doc_id", *(field(ways).alias(name) for name, ways in patterns.items()), subject.alias("assunto_principal"))


def content_sections(docs: DataFrame, heads=SECTION_HEADS, min_chars: int = 50, cut: int = 3000) -> DataFrame:
    """doc_id, ordem, tipo, content: sections by their heads (over min_chars, cut, with ordinal); large paragraphs where none is found."""

    def section(head: str) -> Column:
        # up to the first empty sentence, without the last full stop: no repeated group, whose matching would go as deep as a text has sentences
        rest = F.regexp_extract("text", rf"(?isu){head}([^.].*)", 1)
        return _stripped(F.regexp_replace(F.substring_index(rest, "..", 1), r"\.\z", ""))

    listed = F.array(*(F.struct(F.lit(t).alias("tipo"), section(h).alias("content")) for t, h in heads))
    found = F.filter(listed, lambda s: F.length(s["content"]) > min_chars)
    large = F.slice(F.filter(F.transform(F.split("text", "\n\n"), _stripped), lambda x: F.length(x) > 100), 1, 10)
    plain = F.transform(large, lambda x, i: F.struct(F.concat(F.lit("paragrafo_"), (i + 1).cast("string")).alias("tipo"), x.alias("content")))
    # the sections once, then which of the two lists a document has
    d = docs.select("doc_id", found.alias("found"), plain.alias("plain")).select("doc_id", F.posexplode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.col("plain"))).alias("i", "s"))
    return d.select("doc_id", (F.col("i") + 1).alias("ordem"), F.col("s.tipo").alias("tipo"), F.substring("s.content", 1, cut).alias("content"))


def last_contexts(contexts: Column, keep: int = 10) -> Column:
    """The last `keep` of a list of contexts; the whole list if it is shorter."""
    return F.when(F.size(contexts) > keep, F.slice(contexts, -keep, keep)).otherwise(contexts)


def scrape_status(pages: DataFrame, cached_urls: DataFrame, stored_numbers: DataFrame) -> DataFrame:
    """already_processed (url seen), already_exists (number stored), error (no content) or success."""
    seen = cached_urls.select(F.md5("url").alias("url_hash")).distinct().withColumn("_seen", F.lit(1))
    stored = stored_numbers.select("number").distinct().withColumn("_stored", F.lit(1))
    number = tx.process_number("html", F.concat(F.lit("processo_"), F.col("page_id").cast("string")))
    d = pages.select("page_id", F.md5("url").alias("url_hash"), number.alias("number"), F.length(F.trim("html")).alias("_chars")).join(seen, "url_hash", "left").join(stored, "number", "left")
    return d.select("page_id", F.when(F.col("_seen") == 1, "already_processed").when(F.col("_stored") == 1, "already_exists").when(F.coalesce("_chars", F.lit(0)) <= 100, "error").otherwise("success").alias("status"))
