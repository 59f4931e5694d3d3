"""Sections and entities: extraction that needs match positions, in Arrow batches.

Python's regexes give positions, so these run in mapInPandas; each text is handled
alone and only once.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dictionaries import ENTITY_RULES, NAME_PARTICLES, SECTION_ENDS, SECTION_RULES, SECTION_TYPE_NAMES, TAGGER_LABELS, EntityRule, SectionRule

GENERIC_CHARS = 5000


def strip_section(content: str) -> str:
    """Blank runs and line breaks collapse; ruler lines and empty lines go."""
    text = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", content))
    lines = (x.strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x and not re.fullmatch(r"[_\-=*]{3,}", x))


class SectionFinder:
    """Rules by priority; per pattern the first valid match; a section that overlaps an accepted one is dropped."""

    def __init__(self, rules=SECTION_RULES, ends=SECTION_ENDS, generic: bool = True):
        order = sorted(rules, key=lambda r: -r.priority)
        self.rules = [(r, [(h, re.compile(h, re.M | re.S)) for h in r.headings], [re.compile("(?i)" + i) for i in r.indicators]) for r in order]
        self.ends = [re.compile(e, re.M) for e in ends]
        self.generic = generic

    def _content(self, text: str, start: int, rule: SectionRule) -> str | None:
        stop = min(len(text) - start, rule.max_chars)
        for end in self.ends:
            # the first end indicator after the least length; positions are those of the rest of the text
            for m in end.finditer(text[start : start + rule.max_chars + 64]):
                if m.start() > rule.min_chars:
                    stop = min(stop, m.start())
                    break
        return text[start : start + stop].strip() if stop > rule.min_chars else None

    @staticmethod
    def valid(content: str, rule: SectionRule, indicators: list[re.Pattern]) -> bool:
        if not rule.min_chars <= len(content) <= rule.max_chars or len(content.split()) < 10:
            return False
        if sum(x.isalnum() for x in content) < 0.6 * len(content):
            return False
        return not indicators or any(i.search(content) for i in indicators)

    def find(self, text: str) -> list[tuple]:
        """(type, start, end, content, pattern) in order of start."""
        taken: list[tuple] = []
        for rule, headings, indicators in self.rules:
            for source, heading in headings:
                for m in heading.finditer(text):
                    content = self._content(text, m.start(), rule)
                    if content and self.valid(content, rule, indicators):
                        end = m.start() + len(content)
                        if all(end <= t[1] or m.start() >= t[2] for t in taken):
                            taken.append((rule.section_type, m.start(), end, content, source))
                        break
        taken.sort(key=lambda t: t[1])
        if not taken and self.generic and len(text) > 200:
            cut = text[:GENERIC_CHARS] + "..." if len(text) > GENERIC_CHARS else text
            taken.append(("outros", 0, len(cut), cut, ""))
        return taken


SECTION_SCHEMA = "section_id string, section_type string, ordem int, start int, length int, content string, clean string, pattern string, error string"


def extract_sections(docs: DataFrame, rules=SECTION_RULES, ends=SECTION_ENDS, generic: bool = True) -> DataFrame:
    """docs(doc_id, text) -> one row per section; a text that fails gives one row with its error."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        finder = SectionFinder(rules, ends, generic)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                try:
                    for i, (kind, start, _, content, pattern) in enumerate(finder.find(text or "")):
                        rows.append((doc, f"sec_{doc}_{kind}_{i}", kind, i + 1, start, len(content), content, strip_section(content), pattern, None))
                except Exception as e:  # one bad text doesn't end the job; it is reported
                    rows.append((doc, None, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", *(x.split()[0] for x in SECTION_SCHEMA.split(", "))]).astype({"ordem": "Int32", "start": "Int32", "length": "Int32"})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, {SECTION_SCHEMA}")


def generic_section(text: Column) -> Column:
    """The fallback section of a text without headings, or null."""
    return F.when(F.length(text) > 200, F.when(F.length(text) > GENERIC_CHARS, F.concat(F.substring(text, 1, GENERIC_CHARS), F.lit("..."))).otherwise(text))


def section_type(name: Column, default: str = "outros") -> Column:
    """Stored section names, accented or not, to their type."""
    m = F.create_map(*(F.lit(x) for kv in SECTION_TYPE_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(m, F.lower(F.trim(name))), F.lit(default))


def tagger_type(label: Column) -> Column:
    """Entity type of an external tagger's label, or null."""
    m = F.create_map(*(F.lit(x) for kv in TAGGER_LABELS.items() for x in kv))
    return F.try_element_at(m, F.upper(label))


def context_boost(text: str, found: str, words: tuple[str, ...], width: int = 50) -> float:
    at = text.find(found)
    around = text[max(0, at - width) : at + len(found) + width] if at >= 0 else ""
    return 0.1 * sum(1 for w in words if re.search(rf"(?i)\b{w}\b", around))


def entity_confidence(found: str, text: str, rule: EntityRule) -> float:
    score = min(1.0, 0.8 + context_boost(text, found, rule.context))
    if len(found) < 3:
        score *= 0.7
    if rule.entity_type not in ("lei", "advogado") and sum(x.isdigit() for x in found) > 0.3 * len(found):
        score *= 0.8
    return min(1.0, score)


def resolve_overlaps(found: list[tuple]) -> list[tuple]:
    """(start, end, confidence, ...) in order of start: an entity that overlaps accepted ones replaces the first of them if strictly more confident, else goes."""
    kept: list[tuple] = []
    for e in sorted(found, key=lambda x: x[0]):
        clash = next((i for i, k in enumerate(kept) if not (e[1] <= k[0] or e[0] >= k[1])), None)
        if clash is None:
            kept.append(e)
        elif e[2] > kept[clash][2]:
            del kept[clash]
            kept.append(e)
    return kept


def final_name(kind: str, name: str) -> str:
    """Squeezed; people in proper-name case, places in title case."""
    name = re.sub(r"\s+", " ", name).strip()
    if kind in ("juiz", "advogado", "pessoa"):
        words = name.lower().split(" ")
        return " ".join(w if i and w in NAME_PARTICLES else w[:1].upper() + w[1:] for i, w in enumerate(words))
    return name.title() if kind == "comarca" else name


class EntityFinder:
    def __init__(self, rules=ENTITY_RULES):
        self.rules = [(r, [re.compile(p, re.M | re.I) for p in r.patterns]) for r in rules]

    def find(self, text: str, more: list[tuple] = ()) -> list[tuple]:
        """(start, end, confidence, type, text, name, pattern); `more` are a tagger's entities of the same form, put first."""
        found = list(more)
        for rule, patterns in self.rules:
            for p in patterns:
                for m in p.finditer(text):
                    g = 1 if m.re.groups else 0
                    raw = (m.group(g) or "").strip()
                    if len(raw) < 2:
                        continue
                    score = entity_confidence(raw, text, rule)
                    if score >= rule.min_confidence:
                        name = raw
                        for old, new in rule.rewrites:
                            name = re.sub(old, new, name)
                        found.append((m.start(g), m.end(g), score, rule.entity_type, raw, name.strip(), p.pattern))
        return [(*e[:5], final_name(e[3], e[5]), e[6]) for e in resolve_overlaps(found)]


ENTITY_SCHEMA = "entity_type string, original string, name string, start int, end int, confidence double"


def extract_entities(docs: DataFrame, rules=ENTITY_RULES, tagger=None) -> DataFrame:
    """docs(doc_id, text) -> typed entities with their place and confidence.

    tagger: an optional function text -> [(start, end, label, text)], taken at confidence 0.7.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        finder = EntityFinder(rules)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                text = text or ""
                more = [(s, e, 0.7, TAGGER_LABELS[label.upper()], t, t, "tagger") for s, e, label, t in tagger(text) if label.upper() in TAGGER_LABELS] if tagger else []
                rows += [(doc, kind, raw, name, s, e, round(c, 6)) for s, e, c, kind, raw, name, _ in finder.find(text, more)]
            yield pd.DataFrame(rows, columns=["doc_id", *(x.split()[0] for x in ENTITY_SCHEMA.split(", "))]).astype({"start": "int32", "end": "int32", "confidence": "float64"})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, {ENTITY_SCHEMA}")


def entity_frequency(entities: DataFrame, min_frequency: int = 2, per_type: bool = False) -> DataFrame:
    """name, entity_type, original (of the first mention), frequency. Names are joined across types unless per_type."""
    keys = ["name", "entity_type"] if per_type else ["name"]
    d = entities.withColumn("name", F.lower("name"))
    first = F.min_by(F.struct("entity_type", "original"), F.struct("doc_id", "start", "entity_type"))
    out = d.groupBy(*keys).agg(first.alias("f"), F.count("*").alias("frequency")).where(F.col("frequency") >= min_frequency)
    return out.select("name", F.col("f.entity_type").alias("entity_type"), F.col("f.original").alias("original"), "frequency")


def names_over(entities: DataFrame, entity_type: str, confidence: float) -> DataFrame:
    """Distinct names of a type over a confidence: judges over 0.8, laws over 0.7."""
    return entities.where((F.col("entity_type") == entity_type) & (F.col("confidence") > confidence)).select("name").distinct()


def snippets(docs: DataFrame, term: str, width: int = 50, cut: int = 150, per_doc: int = 2, at_most: int | None = 5) -> DataFrame:
    """doc_id, i, snippet: text around each place of a term, squeezed and cut; the first per document and overall."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    pattern = re.compile(rf"(?i)\b{re.escape(term)}\b")

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                for i, m in zip(range(per_doc), pattern.finditer(text or ""), strict=False):
                    s = re.sub(r"\s+", " ", text[max(0, m.start() - width) : m.end() + width]).strip()
                    rows.append((doc, i, s[:cut] + "..." if len(s) > cut else s))
            yield pd.DataFrame(rows, columns=["doc_id", "i", "snippet"]).astype({"i": "int32"})

    out = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, i int, snippet string").orderBy("doc_id", "i")
    return out.limit(at_most) if at_most is not None else out
