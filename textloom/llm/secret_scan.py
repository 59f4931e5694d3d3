"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is named by the SHA-256 of its content (null: empty).
The ledger holds (blob, rule_version, findings); a scan joins the distinct blobs to
it, runs the rules on the unseen (blob, rule version) pairs alone, appends their findings
(also empty ones) and joins findings back to all paths. A changed rule set has
another version, so its blobs count as unseen; the ledger is stored by rule version, and a run reads its own alone.

A rule's matches are leftmost and non-overlapping. Their places come from the text
split by the rule: the n-th match begins after n + 1 pieces and n matches, all counted
in code points. Rules with a literal are run only where the text holds it.

Edge cases. Null and empty text share the empty blob and have no findings. Copies
are scanned once; a hot blob is pre-aggregated before the shuffle, and its paths (ids
only) meet its findings in a join that splits skewed partitions. Spans of different
kinds may overlap and all stay. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, fresh_path


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    any_of: tuple[str, ...] = ()  # the text must hold one of these; compared in lower case if fold
    fold: bool = False
    group: int = 0
    group_chars: int = 0  # drop matches whose group is shorter


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("password", "passwd", "secret", "token", "apikey", "api_key"), True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", ("AKIA",), False, 0, 20),
    # a run of hex digits is one match, so its length can stand in the pattern
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    Rule("vcs_token", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,900}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",)),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}", ("AIza",)),
    Rule("url_login", r"://[^/\s:@]{1,64}:[^/\s:@]{3,64}@", ("://",)),
)
RULES = BASE_RULES + MORE_RULES

FINDINGS = "array<struct<start:int,kind_order:int,end:int,kind:string>>"
LEDGER_SCHEMA = f"blob binary, rule_version string, findings {FINDINGS}"


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()


def _matches(text: Column, folded: Column, rule: Rule, group: int) -> Column:
    """All matches of a rule, or of one of its groups; null where a literal is missing."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), group)
    if not rule.any_of:
        return found
    where = folded if rule.fold else text
    hit = F.lit(False)
    for s in rule.any_of:
        hit = hit | F.contains(where, F.lit(s))
    return F.when(hit, found)


def _running(values: Column, zero: Column, merge) -> Column:
    """The running merges of an array, itself included (merge must be associative, with `zero` neutral).

    The array is cut into about sqrt(n) blocks of sqrt(n) values: each block is merged, then the blocks before each, then the values
    before each in its block. So n values take n * sqrt(n) steps, and no array is grown value by value.
    """
    n = F.size(values)
    block = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    fold = lambda part: F.aggregate(part, zero, merge)
    sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda j: fold(F.slice(values, j * block + 1, block)))
    # one struct, so that what comes before a block is computed once for it
    state = F.struct(values.alias("v"), sums.alias("s"), block.alias("b"))
    blocks = F.transform(F.array(state), lambda c: F.transform(c["s"], lambda _, j: F.struct(F.aggregate(F.slice(c["s"], 1, j), zero, merge).alias("before"), F.slice(c["v"], j * c["b"] + 1, c["b"]).alias("own"))))
    per = F.transform(blocks[0], lambda x: F.transform(x["own"], lambda _, i: merge(x["before"], F.aggregate(F.slice(x["own"], 1, i + 1), zero, merge))))
    return F.when(n > 0, F.flatten(per)).otherwise(F.array().cast("array<int>"))


def _rule_spans(order: int, rule: Rule) -> Column:
    """Spans from the columns m<order> (matches), g<order> (groups) and p<order> (pieces between the matches)."""
    empty = F.lit([]).cast(FINDINGS)
    m, g, pieces = F.col(f"m{order}"), F.col(f"g{order}" if rule.group else f"m{order}"), F.col(f"p{order}")
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(m)).alias("piece"), m.alias("match"))
    ends = _running(F.transform(zipped, lambda x: F.length(x["piece"]) + F.length(x["match"])), F.lit(0), lambda x, y: x + y)
    spans = F.zip_with(F.arrays_zip(m.alias("match"), g.alias("grp")), ends, lambda x, end: F.struct((end - F.length(x["match"])).alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.length(x["grp"]).alias("chars")))
    kept = F.transform(F.filter(spans, lambda x: x["chars"] >= rule.group_chars), lambda x: x.dropFields("chars"))
    return F.when(F.size(m) > 0, kept).otherwise(empty)


def findings(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blobs(blob, text) -> blob, findings ordered by start, then kind as listed."""
    text, folded = F.col("text"), F.lower(F.col("text"))
    d = blobs.select("blob", "text", *(_matches(text, folded, r, 0).alias(f"m{i}") for i, r in enumerate(rules)))
    # groups and pieces only where something matched
    extra = [F.when(F.size(f"m{i}") > 0, F.split(text, r.pattern, -1)).alias(f"p{i}") for i, r in enumerate(rules)]
    extra += [F.when(F.size(f"m{i}") > 0, F.regexp_extract_all(text, F.lit(r.pattern), r.group)).alias(f"g{i}") for i, r in enumerate(rules) if r.group]
    d = d.select("blob", *(f"m{i}" for i in range(len(rules))), *extra)
    return d.select("blob", F.array_sort(F.concat(*(_rule_spans(i, r) for i, r in enumerate(rules)))).alias("findings"))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER_SCHEMA)


def scan_new(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the blobs of versions(text) that the ledger lacks, append them, and return the ledger of this rule version."""
    spark, version = versions.sparkSession, rule_version(rules)
    seen = read_ledger(spark, ledger_path).where(F.col("rule_version") == version).select("blob")
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(seen, "blob", "left_anti")
    findings(unseen, rules).select("blob", F.lit(version).alias("rule_version"), "findings").write.mode("append").partitionBy("rule_version").parquet(ledger_path)
    # two runs that append the same blob append the same findings
    return read_ledger(spark, ledger_path).where(F.col("rule_version") == version).dropDuplicates(["blob"]).select("blob", "findings")


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_findings(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """rows with a column `blob` -> the same with `findings`; each blob is in the ledger, so a miss there has none."""
    hits = ledger.where(F.size("findings") > 0)
    # counted first, blobs and spans (about 60 bytes each): beyond the bound both sides are shuffled
    n = hits.agg(F.count("*") + F.coalesce(F.sum(F.size("findings")), F.lit(0))).first()[0]
    hits = F.broadcast(hits) if n <= BROADCAST_ROWS // 4 else hits
    return rows.join(hits, "blob", "left").withColumn("findings", F.coalesce("findings", F.lit([]).cast(FINDINGS)))


def secret_scan(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs(doc_id, text): counts per base kind, digest of the base spans, all spans."""
    ledger = scan_new(docs, ledger_path or fresh_path(docs.sparkSession, "blob_ledger"), rules)
    rows = with_findings(docs.select("doc_id", blob_of(F.col("text")).alias("blob")), ledger)

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("findings", lambda s: s["kind_order"] < len(BASE_RULES))
    return rows.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES),
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("findings")).alias("spans"),
    )


# Code points of the pieces that a text is cut into, once, before spans are taken out.
_PIECE = 4096


def _without(text: Column, spans: Column, mark: str) -> Column:
    """text with each run of overlapping spans (ordered by start) replaced by `mark`."""
    reach = _running(F.transform(spans, lambda x: x["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
    state = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), 0).alias("pieces"), F.transform(spans, lambda x: x["start"]).alias("starts"), reach.alias("reach"), F.length(text).alias("n"))

    def cut(c: Column) -> Column:
        # a span that begins at or after all ends before it begins a run, and what lies between stays
        before = F.concat(F.array(F.lit(0)), F.slice(c["reach"], 1, F.size(c["reach"]) - 1))
        runs = F.filter(F.arrays_zip(before.alias("a"), c["starts"].alias("b")), lambda x: x["b"] >= x["a"])
        kept = F.concat(runs, F.array(F.struct(F.element_at(c["reach"], -1).alias("a"), c["n"].alias("b"))))
        return F.array_join(F.transform(kept, lambda x: _between(c["pieces"], x["a"], x["b"])), mark)

    return F.transform(F.array(state), cut)[0]


def _between(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of the text that the pieces make up."""
    first, last = F.floor(a / _PIECE).cast("int"), F.floor((b - 1) / _PIECE).cast("int")
    head, tail = F.get(pieces, first), F.get(pieces, last)
    far = F.concat(F.substring(head, a % _PIECE + 1, F.lit(_PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(tail, F.lit(1), b - last * _PIECE))
    return F.when(b <= a, "").when(first == last, F.substring(head, a % _PIECE + 1, b - a)).otherwise(far)


def redact(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by `mark`; overlapping spans become one. Other texts are untouched; n_chars, if there, follows."""
    names = docs.columns
    ledger = scan_new(docs, ledger_path or fresh_path(docs.sparkSession, "blob_ledger"), rules)
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    rows = with_findings(docs.select(row, blob_of(F.col("text")).alias("blob")), ledger)
    text = F.col("row")["text"]
    rows = rows.withColumn("new_text", F.when(F.size("findings") > 0, _without(text, F.col("findings"), mark)).otherwise(text))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("new_text").alias(c)
        if c == "n_chars":
            return F.when(F.size("findings") > 0, F.length("new_text").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c)
        return F.col("row")[c].alias(c)

    return rows.select(*(column(c) for c in names))
