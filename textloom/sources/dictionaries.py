"""Default dictionaries and patterns of the legal domain.

They are data: every operator takes them as parameters, so another domain brings its own.
"""

from __future__ import annotations

from dataclasses import dataclass

# The predefined concepts.
PREDEFINED_CONCEPTS = (
    "empréstimo consignado", "consignação em folha", "desconto em folha", "margem consignável", "servidor público", "aposentado", "pensionista",
    "vício de consentimento", "fraude", "dolo", "erro", "coação", "má-fé", "boa-fé",
    "dano moral", "dano material", "lucros cessantes", "danos emergentes", "repetição de indébito", "repetição em dobro", "restituição",
    "tutela antecipada", "liminar", "sentença", "acórdão", "recurso", "apelação", "embargos",
    "relação de consumo", "código de defesa do consumidor", "vulnerabilidade", "hipossuficiência", "prática abusiva", "cláusula abusiva",
    "instituição financeira", "banco", "contrato bancário", "taxa de juros", "juros abusivos", "capitalização", "anatocismo",
)


@dataclass(frozen=True)
class Category:
    name: str
    keywords: tuple[str, ...]
    concepts: tuple[str, ...]
    weight: float


# Categories in matching order.
CATEGORIES = (
    Category(
        "Empréstimo Consignado",
        ("consignado", "consignação", "folha", "desconto", "margem"),
        ("empréstimo consignado", "consignação em folha", "desconto em folha de pagamento", "margem consignável", "servidor público", "aposentado", "pensionista", "INSS", "contracheque"),
        2.0,
    ),
    Category(
        "Vícios e Fraudes",
        ("vício", "fraude", "dolo", "erro", "coação", "má-fé"),
        ("vício de consentimento", "fraude", "dolo", "erro", "coação", "má-fé", "boa-fé", "lesão enorme", "estado de perigo", "prática abusiva"),
        1.8,
    ),
    Category(
        "Danos e Reparação",
        ("dano", "indenização", "reparação", "ressarcimento", "restituição"),
        ("dano moral", "dano material", "danos emergentes", "lucros cessantes", "repetição de indébito", "repetição em dobro", "restituição", "ressarcimento", "indenização"),
        1.7,
    ),
    Category(
        "Direito Bancário",
        ("banco", "instituição", "financeira", "crédito", "juros"),
        ("instituição financeira", "banco", "contrato bancário", "taxa de juros", "juros abusivos", "capitalização", "anatocismo", "spread bancário", "tarifa bancária"),
        1.6,
    ),
    Category(
        "Direito do Consumidor",
        ("consumidor", "fornecedor", "relação", "vulnerabilidade"),
        ("relação de consumo", "código de defesa do consumidor", "CDC", "vulnerabilidade", "hipossuficiência", "prática abusiva", "cláusula abusiva", "publicidade enganosa", "venda casada"),
        1.5,
    ),
    Category(
        "Processo Civil",
        ("tutela", "liminar", "sentença", "recurso", "execução"),
        ("tutela antecipada", "liminar", "sentença", "acórdão", "recurso", "apelação", "embargos", "agravo", "execução", "cumprimento de sentença"),
        1.2,
    ),
)


def all_concepts(extra: tuple[str, ...] = ()) -> list[str]:
    """Predefined concepts, then those only a category names, then extra ones; no repeats."""
    return list(dict.fromkeys([*PREDEFINED_CONCEPTS, *(c for g in CATEGORIES for c in g.concepts), *extra]))


# Words that never make a concept of their own.
STOP_WORDS = (
    "a", "o", "e", "de", "do", "da", "em", "um", "uma", "com", "não", "que", "por", "para", "se", "na", "no", "é", "são",
    "art", "artigo", "inc", "inciso", "parágrafo", "alínea", "item", "cf", "cfr", "vide", "ver", "pág", "página", "fls", "folhas",
    "dr", "dra", "des", "desembargador", "desembargadora", "mm", "meritíssimo", "dd", "digníssimo", "exmo", "exma",
    "processo", "autos", "ref", "referente", "rel", "relator", "rev", "revisor", "red", "redator", "proc",
    "assim", "desta", "neste", "dessa", "nessa", "deste", "portanto", "entanto", "quanto", "quando", "onde", "sendo", "tendo", "havendo", "devendo",
)

# The names under which sections are stored, accented or not.
SECTION_TYPE_NAMES = {
    "relatorio": "relatorio", "relatório": "relatorio", "decisao": "decisao", "decisão": "decisao", "dispositivo": "dispositivo", "ementa": "ementa", "voto": "voto",
}


@dataclass(frozen=True)
class SectionRule:
    section_type: str
    headings: tuple[str, ...]
    priority: int
    min_chars: int
    max_chars: int
    indicators: tuple[str, ...] = ()


_AT_LINE = r"(?i)(?:^|\n)\s*"

# Heading patterns, priorities and length bounds of the section types.
SECTION_RULES = (
    SectionRule(
        "ementa",
        (r"(?i)^[\s\n]*EMENTA\s*[:.]?", r"(?i)^[\s\n]*E\s*M\s*E\s*N\s*T\s*A\s*[:.]?", r"(?i)EMENTA\s*[-:]", r"(?i)^\s*EMENTA\s+[A-Z]"),
        10, 100, 2000,
        ("direito", "civil", "comercial", "processo", "recurso", "apela[çã]", "consignado", "empréstimo", "banco"),
    ),
    SectionRule(
        "dispositivo",
        tuple(_AT_LINE + h for h in (
            r"DISPOSITIVO\s*[:.]?", r"ISTO\s+POSTO", r"ANTE\s+O\s+EXPOSTO", r"DIANTE\s+DO\s+EXPOSTO", r"EX\s+POSITIS", r"PELO\s+EXPOSTO", r"FACE\s+AO\s+EXPOSTO",
            r"POR\s+ESTES?\s+FUNDAMENTOS?", r"ACORDAM\s+OS\s+DESEMBARGADORES", r"DECIDE[M-SE]?\s*[:.]", r"JULGO\s+PROCEDENTE", r"JULGO\s+IMPROCEDENTE",
            r"DOU\s+PROVIMENTO", r"NEGO\s+PROVIMENTO", r"MANTENHO\s+A\s+SENTEN[ÇÃ]A",
        )),
        10, 100, 3000,
        (r"\bjulgo", r"\bdecido", r"\bacordam", r"\bprovimento", r"\bprocedente", r"\bimprocedente", r"\bmantenho", r"\breformo", r"\bconfirmo"),
    ),
    SectionRule(
        "decisao",
        (
            *(_AT_LINE + h for h in (r"DECIS[ÃÃO]O\s*[:.]?", r"FUNDAMENTA[ÇÃ][ÃÃO]O\s*[:.]?", r"VOTO\s+DO\s+REL[AÁ]T[OÓ]R", r"É\s+O\s+VOTO", r"ENTENDO\s+QUE", r"ANTE\s+O\s+EXPOSTO", r"DIANTE\s+DO\s+EXPOSTO")),
            r"(?i)PASSO\s+AO\s+EXAME", r"(?i)CUMPRE\s+ANALISAR", r"(?i)ASSIM\s+SENDO",
        ),
        9, 300, 8000,
    ),
    SectionRule(
        "relatorio",
        (
            *(_AT_LINE + h for h in (r"REL[AÁ]T[OÓ]RIO\s*[:.]?", r"R\s*E\s*L\s*A\s*T\s*[OÓ]\s*R\s*I\s*O\s*[:.]?", r"O\s+REL[AÁ]T[OÓ]R", r"RELATA?\s+O\s+[A-Z]")),
            r"(?i)RELATORA?\s+[A-Z][a-z]+.*?[A-Z][a-z]+.*?relat",
        ),
        8, 200, 5000,
    ),
    SectionRule(
        "voto",
        (*(_AT_LINE + h for h in (r"VOTO\s*[:.]?", r"V\s*O\s*T\s*O\s*[:.]?", r"MEU\s+VOTO")), r"(?i)VOTO\s+DO\s+RELATOR", r"(?i)VOTO\s+DA\s+RELATORA", r"(?i)VOTO\s+CONDUTOR"),
        7, 200, 4000,
    ),
)

# Where a section ends.
SECTION_ENDS = (
    r"(?i)(?:^|\n)\s*(?:REL[AÁ]T[OÓ]RIO|DECIS[ÃÃO]O|DISPOSITIVO|VOTO|EMENTA)\s*[:.]",
    r"(?i)(?:^|\n)\s*(?:ISTO\s+POSTO|ANTE\s+O\s+EXPOSTO|PELO\s+EXPOSTO)",
    r"(?i)(?:^|\n)\s*(?:ACORDAM|DECIDE|JULGO)",
    r"(?:^|\n)\s*_{10,}",
    r"(?:^|\n)\s*={10,}",
    r"(?:^|\n)\s*-{10,}",
)


@dataclass(frozen=True)
class EntityRule:
    entity_type: str
    patterns: tuple[str, ...]
    rewrites: tuple[tuple[str, str], ...]
    context: tuple[str, ...]
    min_confidence: float = 0.7


_NAME = r"([A-Z][a-záêçõâô]+(?:\s+[A-Z][a-záêçõâô]+){1,3})"
_FULL_NAME = r"([A-Z][a-záêçõâô]+(?:\s+[A-Z][a-záêçõâô]+){2,4})"

# Entity patterns, rewrites and context words.
ENTITY_RULES = (
    EntityRule(
        "juiz",
        (
            r"Des(?:embargador)?\.?\s+" + _NAME, r"Desª?\.?\s+" + _NAME, r"Desembargadora?\s+" + _NAME, r"Juiz(?:a)?\s+" + _NAME, r"(?:Dr|Dra)\.?\s+" + _NAME,
            r"(?:Exmo|Exma)\.?\s+(?:Sr|Sra)\.?\s+(?:Dr|Dra)\.?\s+" + _NAME, r"Relator(?:a)?:?\s+(?:Des\.?\s+|Dr\.?\s+)?" + _NAME, r"(?:Rel|Relatora?)\.?\s+" + _NAME,
        ),
        ((r"(?i)^des\.?\s+", ""), (r"(?i)^dr\.?\s+", ""), (r"(?i)^juiz(?:a)?\s+", "")),
        ("relator", "relatora", "presidente", "revisor", "desembargador", "desembargadora", "magistrado"),
    ),
    EntityRule(
        "advogado",
        (
            r"(?:Dr|Dra)\.?\s+" + _NAME + r",?\s+OAB[/-]?(?:PI)?[/-]?\s*(\d+)", r"(?:Advogado|Advogada)\s+" + _NAME, _NAME + r",?\s+(?:inscrito|inscrita)\s+(?:na\s+)?OAB",
            r"OAB[/-]?(?:PI)?[/-]?\s*(\d{3,6})", r"inscri[çã][ãç]o\s+(?:na\s+)?OAB[/-]?(?:PI)?[/-]?\s*[nº]?\s*(\d{3,6})",
        ),
        ((r"(?i)^(?:dr|dra)\.?\s+", ""), (r"(?i),?\s+oab.*$", "")),
        ("advogado", "advogada", "procurador", "procuradora", "causídico", "patrono", "defensor", "constituído"),
    ),
    EntityRule(
        "comarca",
        (
            r"(\d+[ªº]?\s+Vara\s+(?:Cível|Criminal|da\s+Fazenda|de\s+Família|Empresarial)(?:\s+de\s+[A-Z][a-záêçõâô]+)?)", r"(Comarca\s+de\s+[A-Z][a-záêçõâô]+)",
            r"(Foro\s+(?:Central\s+)?de\s+[A-Z][a-záêçõâô]+)", r"(Tribunal\s+de\s+Justi[çã]a\s+do?\s+[A-Z][a-záêçõâô]+)", r"(TJ-?(?:PI|MA|CE|BA|PE|RN|PB|AL|SE))",
            r"(\d+[ªº]?\s+(?:Câmara|Turma)\s+(?:Cível|Criminal)?)", r"((?:Primeira|Segunda|Terceira|Quarta|Quinta)\s+(?:Câmara|Turma))",
        ),
        ((r"(?i)\s+de\s+teresina", " de Teresina"), (r"(?i)tj-?pi", "TJPI")),
        ("vara", "comarca", "tribunal", "foro", "juízo"),
    ),
    EntityRule(
        "lei",
        (
            r"(Lei\s+(?:Federal\s+)?n?[º°]?\s*(\d+(?:\.\d+)*)[/-]?(\d{2,4}))", r"(Lei\s+(\d+(?:\.\d+)*)[/-](\d{2,4}))",
            r"(Código\s+(?:Civil|Penal|de\s+Processo\s+Civil|de\s+Processo\s+Penal|de\s+Defesa\s+do\s+Consumidor))", r"(CC[/-]?\d{2})", r"(CPC[/-]?\d{2})", r"(CDC)",
            r"(art(?:igo)?s?\.?\s+(\d+(?:[º°]|[-ªº])?(?:\s*,\s*\d+)*)[º°]?(?:\s+(?:a\s+\d+))?)", r"(§\s*(\d+)[º°]?)", r"(inc(?:iso)?\.?\s+([IVX]+|\d+))",
            r"(Súmula\s+(?:Vinculante\s+)?n?[º°]?\s*(\d+)(?:\s+do\s+(STF|STJ|TST))?)", r"(Constitui[çã][ãç]o\s+Federal)", r"(CF[/-]?\d{2})",
        ),
        ((r"(?i)^lei\s+federal\s+", "Lei "), (r"(?i)^artigos?\.\s+", "Art. "), (r"(?i)[º°]", "º")),
        ("legislação", "dispositivo", "diploma", "norma"),
    ),
    EntityRule(
        "orgao",
        (
            r"(Banco\s+(?:do\s+)?(?:Brasil|Central|Nordeste|Bradesco|Itaú|Santander|Caixa))", r"(CEF|BB|BACEN)", r"(Caixa\s+Econômica\s+Federal)",
            r"(INSS|Receita\s+Federal|Ministério\s+Público|MPE?-?PI)", r"(Defensoria\s+Pública)", r"(Procuradoria\s+(?:Geral\s+)?do\s+Estado)",
            r"(\d+[º°]?\s+(?:Cartório|Tabelionato|Ofício))", r"(Cartório\s+de\s+(?:Registro\s+)?(?:Civil|Imóveis|Títulos))",
        ),
        ((r"(?i)^banco\s+do\s+", "Banco "), (r"(?i)cef", "Caixa Econômica Federal")),
        ("instituição", "órgão", "entidade", "autarquia"),
    ),
    EntityRule(
        "pessoa",
        (
            r"(?:autor|autora|requerente):?\s+" + _FULL_NAME, r"(?:réu?|ré|requerido|requerida):?\s+" + _FULL_NAME, r"(?:apelante|apelado|agravante|agravado):?\s+" + _FULL_NAME,
            r"CPF[:\s]*(\d{3}\.?\d{3}\.?\d{3}[-\s]?\d{2})",
        ),
        ((r"(?i)^(?:autor|réu|apelante)a?:?\s+", ""),),
        ("parte", "litigante", "interessado"),
        0.8,
    ),
)

# Labels of external taggers.
TAGGER_LABELS = {"PER": "pessoa", "PERSON": "pessoa", "ORG": "orgao", "LOC": "comarca", "MISC": "outros"}

# Words that stay in lower case inside a proper name.
NAME_PARTICLES = ("de", "da", "do", "das", "dos", "e", "em", "na", "no")

# Spellings that stand for one concept.
CONCEPT_REWRITES = (
    ("código de defesa do consumidor", "CDC"), ("código civil", "CC"), ("código de processo civil", "CPC"),
    ("tribunal de justiça", "TJ"), ("superior tribunal de justiça", "STJ"), ("supremo tribunal federal", "STF"),
)
