"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set are its distinct shingles of k words. Documents with equal sets are
one class, named by a 128-bit digest of the set; only classes are compared. Two
classes link when `den * intersection >= num * union`.

1. Tokens are ordered by (level, hash). The levels come from a sample: of one distinct text in
   `sample`, chosen by its hash, every token is counted, and a token seen f >= 2 times is of
   level log2 f; all others are of level 0. The list of levels is bounded (`hot_rows`; the
   most frequent stay). So what a group of copies or a common passage shares stands behind what
   is a document's own. Only the order rests on the sample; any order gives the same result.
2. One pass over the texts gives each document's set size, digest and prefix. Linked
   sets of sizes n and m share `needed` = ceil(num * (n + m) / (num + den)) tokens, hence at least l of
   the first n - needed + l and m - needed + l. Over all partners that is a prefix
   of n - ceil(t * n) + l tokens, and that many are kept, for the largest l.
3. Per class, l in 1..max_match is chosen by estimated cost: the document frequencies of
   the prefix tokens (postings read) plus their sum over l times the cost of a verification
   (candidates that can share l tokens). A pair takes the smaller l of its two.
4. First each class is held against one pivot (among the postings of its frequent
   tokens the class whose prefix others share most), and what links is merged. Then candidates
   are made only between different components. In a group of near copies of one original,
   a member with more tokens of its own than n - needed shares no token in the prefixes that
   a pair takes, and one with fewer links with the original; so a group costs
   about its size, not its square.
5. Candidates are verified exactly on the texts: each centre is sent with at most
   `site_rows` partners to a site, so no site grows with a group.

`jaccard_components` gives one row per document with its component; `class_links` gives every link
between classes, also those inside a component that pivots have joined.

Edge cases. Fewer than k words: the whole sequence is the one shingle. No words, or
null text: empty set, linked with nothing, a component of its own. Repeated rows are
copies like others. Where ids repeat or are null, rows get numbers of their own first
(one more written copy of the texts); component_id is the least doc_id reached, null only
if no member has one. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, as_bytes, connected_components, discard, map_arrow, restrict, written
from ._shingles import overlap, set_digest, shingle_set


@dataclass(frozen=True)
class Params:
    shingle: int = 3
    num: int = 90
    den: int = 100
    max_match: int = 4
    sample: int = 16
    hot_rows: int = 2_000_000
    pivot_df: int = 4
    pivot_share: float = 0.3
    verify_cost: float = 40.0
    site_rows: int = 256


ROW = "_row"


def _longest(n: int, p: Params) -> int:
    """Tokens kept of a set of n: the prefix for the smallest partner and the largest match count."""
    return min(n, n - -(-p.num * n // p.den) + p.max_match)


def _needed(n: Column, m: Column, p: Params) -> Column:
    """Tokens that linked sets of sizes n and m share."""
    return F.ceil(F.lit(p.num) * (n + m).cast("bigint") / F.lit(p.num + p.den)).cast("int")


def _set_of(text: bytes, p: Params) -> np.ndarray:
    return shingle_set(text.lower().split(), p.shingle)


class _Order:
    """Total order of tokens by (level, hash), from sorted hashes and their levels."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray):
        self.hashes, self.levels = hashes, levels

    def first(self, s: np.ndarray, count: int) -> np.ndarray:
        """The first `count` tokens of a sorted set."""
        if not len(self.hashes) or not len(s):
            return s[:count]
        at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
        hot = np.flatnonzero(self.hashes[at] == s)
        if not len(hot):
            return s[:count]
        level = np.zeros(len(s), np.uint8)
        level[hot] = self.levels[at[hot]]
        return s[np.argsort(level, kind="stable")[:count]]


def _order_of(docs: DataFrame, p: Params) -> _Order:
    """Levels of the tokens that a sample of the distinct texts repeats, at most hot_rows of them."""
    h = F.xxhash64("text")
    texts = docs.select("text", h.alias("h")).where(F.pmod("h", F.lit(p.sample)) == 0).groupBy("h").agg(F.first("text").alias("text")).select("text")

    def tokens(batches):
        for b in batches:
            for data in as_bytes(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(_set_of(data, p).view(np.int64))], ["token"])

    level = F.floor(F.log2("df")).cast("int")
    counts = written(map_arrow(texts, tokens, "token bigint").groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token", level.alias("level")), "levels")
    # how many tokens are of each level: one small row per power of two
    total, least = 0, None
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        if total + r["count"] > p.hot_rows:
            break
        total, least = total + r["count"], r["level"]
    rows = counts.where(F.col("level") >= least).toPandas() if least is not None else None
    discard(counts)
    if rows is None:
        return _Order(np.empty(0, np.uint64), np.empty(0, np.uint8))
    hashes, levels = rows["token"].to_numpy(np.int64).view(np.uint64), rows["level"].to_numpy(np.uint8)
    at = np.argsort(hashes)
    return _Order(hashes[at], levels[at])


def _sets(docs: DataFrame, p: Params) -> DataFrame:
    """docs(node, text) -> node, n, digest, prefix: the first tokens of the set, 8 bytes each."""
    shared = docs.sparkSession.sparkContext.broadcast(_order_of(docs, p))
    id_type = docs.schema["node"].dataType.simpleString()

    def run(batches):
        order = shared.value
        for b in batches:
            n, digest, prefix = [], [], []
            for data in as_bytes(b.column("text")):
                s = _set_of(data, p)
                n.append(len(s))
                digest.append(set_digest(s))
                prefix.append(order.first(s, _longest(len(s), p)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(prefix, pa.binary())], ["node", "n", "digest", "prefix"])

    return map_arrow(docs, run, f"node {id_type}, n int, digest binary, prefix binary")


def _postings(classes: DataFrame) -> DataFrame:
    """classes(node, n, prefix) -> token, node, n, pos."""
    id_type = classes.schema["node"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                b = whole.slice(low, 512)
                prefixes = [np.frombuffer(x, np.int64) for x in b.column("prefix").to_pylist()]
                lengths = [len(x) for x in prefixes]
                at = pa.array(np.repeat(np.arange(len(prefixes)), lengths))
                pos = np.concatenate([np.arange(x, dtype=np.int32) for x in lengths])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes)), b.column("node").take(at), b.column("n").take(at), pa.array(pos)], ["token", "node", "n", "pos"])

    return map_arrow(classes.select("node", "n", "prefix"), run, f"token bigint, node {id_type}, n int, pos int")


def _verified(pairs: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """Of distinct pairs (a, b) of classes, those that link, written. Each centre a is sent with at most site_rows partners to a site."""
    id_type = docs.schema["node"].dataType.simpleString()
    pairs = written(pairs, "pairs")
    deg = pairs.groupBy("a").agg(F.count("*").alias("deg")).where(F.col("deg") > p.site_rows)
    sited = pairs.join(deg, "a", "left").select("a", "b", F.when(F.col("deg").isNotNull(), F.pmod(F.xxhash64("b"), F.ceil(F.col("deg") / p.site_rows))).otherwise(F.lit(0)).cast("int").alias("site"))
    needs = sited.select("a", "site", F.col("a").alias("node"), F.lit(0).alias("role")).distinct().unionByName(sited.select("a", "site", F.col("b").alias("node"), F.lit(1).alias("role")))
    n = 2 * pairs.count()
    texts = docs.join(F.broadcast(needs) if n <= BROADCAST_ROWS // 2 else needs, "node")
    placed = texts.repartition("a", "site").sortWithinPartitions("a", "site", "role", "node").select("a", "site", "role", "node", "text")

    def run(batches):
        at, centre = None, None
        for b in batches:
            first, second = [], []
            for a, site, role, node, data in zip(*(b.column(c).to_pylist() for c in ("a", "site", "role", "node")), as_bytes(b.column("text")), strict=True):
                s = _set_of(data, p)
                if role == 0:
                    at, centre = (a, site), s
                elif at == (a, site):
                    common = overlap(centre, s)
                    if p.den * common >= p.num * (len(centre) + len(s) - common):
                        first.append(a)
                        second.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(x, b.column("node").type) for x in (first, second)], ["a", "b"])

    links = written(map_arrow(placed, run, f"a {id_type}, b {id_type}"), "links")
    discard(pairs)
    return links


def _classed(docs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """The written sets, and node, n, digest, prefix, class: the least node with an equal set."""
    sets = written(_sets(docs, p), "sets")
    copies = written(sets.where("n > 0").groupBy("digest").agg(F.min("node").alias("least"), F.count("*").alias("k")).where("k > 1").select("digest", "least"), "copies")
    joined = sets.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS // 4 else copies, "digest", "left")
    return sets, joined.withColumn("class", F.coalesce("least", "node")).drop("least")


def _shared_tokens(classed: DataFrame, p: Params) -> DataFrame:
    """token, node, n, pos, df of the prefix tokens that several classes hold; written."""
    postings = _postings(classed.where("n > 0 and class = node"))
    tokens = written(postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "tokens")
    tokens_there = F.broadcast(tokens) if tokens.count() <= BROADCAST_ROWS // 2 else tokens
    shared = written(postings.join(tokens_there, "token"), "shared")
    discard(tokens)
    return shared


def _chosen(shared: DataFrame, p: Params) -> DataFrame:
    """node, match: the match count of least cost, weight: how much of the prefix others share, its first tokens above all; written."""
    n = F.col("n")
    within = [F.sum(F.when(F.col("pos") < n - _needed(n, n, p) + m, F.col("df")).otherwise(0)) for m in range(1, p.max_match + 1)]
    costs = F.array(*(F.struct((w + w / m * p.verify_cost).alias("cost"), F.lit(m).alias("m")) for m, w in enumerate(within, 1)))
    return written(shared.groupBy("node").agg(F.array_min(costs)["m"].cast("tinyint").alias("match"), (F.sum(F.col("df") * (_kept(n, p) - F.col("pos"))) / F.first(_kept(n, p))).alias("weight")), "chosen")


def _kept(n: Column, p: Params) -> Column:
    return n - F.ceil(F.lit(p.num) * n / F.lit(p.den)).cast("int") + p.max_match


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it counts at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _pivots(shared: DataFrame, chosen: DataFrame, p: Params) -> DataFrame:
    """Pairs (a: pivot, b): each class and the class that most of its frequent tokens name, if the two share a good part of the prefix."""
    frequent = shared.where(F.col("df") >= p.pivot_df).select("token", "node", "n")
    tops = frequent.join(_few(chosen, BROADCAST_ROWS // 2), "node").groupBy("token").agg(F.max(F.struct("weight", "node")).alias("x")).select("token", F.col("x.node").alias("pivot"))
    votes = frequent.join(tops, "token").where("node <> pivot")
    best = votes.groupBy("node", "pivot").agg(F.count("*").alias("k"), F.first("n").alias("n")).where(F.col("k") >= p.pivot_share * _kept(F.col("n"), p))
    best = best.groupBy("node").agg(F.max(F.struct("k", "pivot")).alias("x"))
    return best.select(F.col("x.pivot").alias("a"), F.col("node").alias("b"))


def _candidates(shared: DataFrame, chosen: DataFrame, parts: DataFrame | None, p: Params) -> DataFrame:
    """Distinct pairs (a, b) of classes that may link; with parts(node, component), of different components only."""
    side = shared.select("token", "node", "n", "pos").join(_few(chosen.select("node", "match"), BROADCAST_ROWS // 2), "node")
    if parts is None:
        side = side.withColumn("component", F.col("node"))
    else:
        side = side.join(_few(parts, BROADCAST_ROWS // 4), "node", "left").withColumn("component", F.coalesce("component", "node"))
        # a token of one component only makes no pair
        side = written(side, "labelled")
        side = side.join(side.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("token"), "token", "left_semi")
    x, y = side.alias("x"), side.alias("y")
    nx, ny, px, py = F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")
    match, needed = F.least("x.match", "y.match").cast("int"), _needed(nx, ny, p)
    both = x.join(y, "token").where(
        (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & (p.den * F.least(nx, ny).cast("bigint") >= p.num * F.greatest(nx, ny).cast("bigint"))
        & (px < nx - needed + match) & (py < ny - needed + match)
        & (F.least(px, py) + F.least(nx - px, ny - py) >= needed)
    )
    counted = both.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("k"), F.first(F.least(match, needed)).alias("least"))
    return counted.where(F.col("k") >= F.col("least")).select("a", "b")


def _components(docs: DataFrame, p: Params) -> DataFrame:
    """docs(node, text) with unique nodes -> node, n, digest, component; written."""
    sets, classed = _classed(docs, p)
    shared = _shared_tokens(classed, p)
    named = classed.select("node", "n", "digest", "class")
    chosen = _chosen(shared, p)
    links = _verified(_pivots(shared, chosen, p), docs, p)
    more = _verified(_candidates(shared, chosen, connected_components(links), p), docs, p)
    discard(shared, chosen)
    parts = connected_components(links.unionByName(more)).withColumnRenamed("node", "class")
    out = named.join(_few(parts, BROADCAST_ROWS // 4), "class", "left").select("node", "n", "digest", F.coalesce("component", "class").alias("component"))
    out = written(out, "components")
    discard(sets, links, more)
    return out


def class_links(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Every link between classes of docs(doc_id, text) with unique ids: (a, b), each the least doc_id of its class, a < b.

    With the class_id of jaccard_components these are all links; copies aren't expanded. The number of rows is that of the links, so it
    grows with the square of a group whose members all link.
    """
    if not _unique(docs):
        raise ValueError("class_links names classes by doc_id, which must be unique and not null")
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    sets, classed = _classed(texts, params)
    shared = _shared_tokens(classed, params)
    links = _verified(_candidates(shared, _chosen(shared, params), None, params), texts, params)
    discard(sets, shared)
    return links


def _unique(docs: DataFrame) -> bool:
    counts = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    return counts[0] == counts[2]


def _by_id(docs: DataFrame, p: Params) -> DataFrame:
    """docs with unique ids -> doc_id, n_shingles, component_id, class_id."""
    parts = _components(docs.select(F.col("doc_id").alias("node"), "text"), p)
    return parts.select(F.col("node").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), F.col("component").alias("component_id"), F.hex("digest").alias("class_id"))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a written number of each row, which later reads don't change."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _by_row(numbered: DataFrame, p: Params) -> DataFrame:
    """Numbered docs -> node, n, digest, component (a node), doc_id."""
    keys = numbered.select(F.col(ROW).alias("node"), "doc_id")
    return _components(numbered.select(F.col(ROW).alias("node"), "text"), p).join(keys, "node")


def jaccard_components(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, class_id (hex digest of the set)."""
    plain = docs.select("doc_id", "text")
    if _unique(plain):
        return _by_id(plain, params)
    parts = _by_row(_numbered(plain), params)
    least = parts.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return parts.join(least, "component").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id", F.hex("digest").alias("class_id"))


def one_of_each(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row of docs for each component, with all its columns: that of the least doc_id (null last), of rows with that id the first by number."""
    if _unique(docs):
        key, rows = "doc_id", docs
        kept = _by_id(docs, params).where("doc_id = component_id").select(key)
    else:
        key, rows = ROW, _numbered(docs)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node"))
        kept = _by_row(rows, params).groupBy("component").agg(first.alias("x")).select(F.col("x.node").alias(key))
    return restrict(rows, written(kept, "kept"), key).select(*docs.columns)
