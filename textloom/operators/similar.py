"""Pairs of vectors over a cosine threshold, met block by block: as rows, or summed up where they are found.

All pairs are quadratic by definition. Blocks bound the memory of a task; each block goes to the tasks that need it, and what
leaves a task is the pairs themselves only where rows are asked for, else a row per vector or group of its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpointed

# Rows of a block: 16,384 vectors of 64 numbers are 8 MB. Fewer if the blocks would be less than LEAST_BLOCKS.
BLOCK_ROWS = 16_384
TRIPLE_ROWS = 65_536
LEAST_BLOCKS = 8
# Cells of the matrix that a task holds at once.
TILE = (256, 4096)


def dealt(df: DataFrame, n: int, column: str) -> DataFrame:
    """df with column's numbers 0 to n - 1 each in a partition of its own (as far as the exchange keeps to n partitions)."""
    spark = df.sparkSession
    wide = spark.range(0, 12 * n + 100, 1, 1).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
    at = {r["p"]: r["k"] for r in wide.groupBy("p").agg(F.min("k").alias("k")).collect()}
    free = iter(range(12 * n + 100, 14 * n + 200))
    keys = [at[p] if p in at else next(free) for p in range(n)]
    return df.withColumn("_k", F.element_at(F.lit(keys), F.col(column) + 1)).repartition(n, "_k").drop("_k").sortWithinPartitions(column)


class Block:
    """Vectors of unit length with their ids, ranks (in id order, over both blocks of a task) and further columns."""

    def __init__(self, table: pa.Table):
        vector = table.column("vector").combine_chunks()
        x = vector.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vector), -1) if len(vector) else np.zeros((0, 1))
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        keep = length > 0
        self.x = x[keep] / length[keep, None]
        self.table = table.drop_columns(["vector"]).filter(pa.array(keep))
        self.ids = self.table.column("id").combine_chunks()

    def __len__(self) -> int:
        return len(self.x)

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()


def ranked(*blocks: Block) -> None:
    """Ranks that compare ids of all the blocks."""
    at = np.unique(np.concatenate([b.ids.to_numpy(zero_copy_only=False) for b in blocks]), return_inverse=True)[1]
    for b in blocks:
        b.rank, at = at[: len(b)], at[len(b) :]


def tiles(left: Block, right: Block, threshold: float) -> Iterator[tuple]:
    """(first row, first column, scores, mask): each pair of the blocks once; blocks are ranked."""
    for r in range(0, len(left), TILE[0]):
        for c in range(0, len(right), TILE[1]):
            s = left.x[r : r + TILE[0]] @ right.x[c : c + TILE[1]].T
            mask = s >= threshold - 1e-12
            if left is right:
                mask &= left.rank[r : r + TILE[0], None] < right.rank[None, c : c + TILE[1]]
            yield r, c, s, mask


def pairs(left: Block, right: Block, threshold: float) -> Iterator[tuple]:
    """Places in both blocks and scores, a tile at a time."""
    for r, c, s, mask in tiles(left, right, threshold):
        p, q = np.nonzero(mask)
        if len(p):
            yield p + r, q + c, s[p, q]


def by_pairs(vectors: DataFrame, run: Callable, schema: str, block_rows: int | None = None) -> DataFrame:
    """run(left, right) -> record batches, for all unordered pairs of blocks of vectors(id, vector, ...); left is right on the diagonal."""
    n = vectors.count()
    blocks = max(1, -(-n // (block_rows or BLOCK_ROWS)), min(LEAST_BLOCKS, -(-n // 1000)))
    meets = list(combinations_with_replacement(range(blocks), 2))
    return _met(vectors, blocks, meets, run, schema)


def _met(vectors: DataFrame, blocks: int, meets: list[tuple], run: Callable, schema: str) -> DataFrame:
    """Each tuple of blocks in `meets` is one call of run with its blocks, in one task."""
    parts = min(len(meets), 4000)
    of = [[m for m, x in enumerate(meets) if b in x] for b in range(blocks)]
    v = vectors.where("vector is not null").withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    spark = vectors.sparkSession
    places = spark.createDataFrame([(b, m, m % parts) for b in range(blocks) for m in of[b]], "_b int, _m int, _p int")
    placed = dealt(v.join(F.broadcast(places), "_b"), parts, "_p").sortWithinPartitions("_m")

    def call(m: int, batches: list) -> Iterator:
        t = pa.Table.from_batches(batches)
        at = t.column("_b").to_numpy()
        found = {b: Block(t.filter(pa.array(at == b)).drop_columns(["_b", "_m", "_p"])) for b in set(meets[m])}
        ranked(*found.values())
        yield from run(*(found[b] for b in meets[m]))

    def task(batches):
        now, held = None, []
        for batch in batches:
            m = batch.column("_m").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(m)) + 1).tolist(), len(m)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if held and m[lo] != now:
                    yield from call(now, held)
                    held = []
                now = int(m[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from call(now, held)

    return placed.mapInArrow(task, schema)


def _type(vectors: DataFrame, name: str = "id") -> str:
    return vectors.schema[name].dataType.simpleString()


def similarity_pairs(vectors: DataFrame, threshold: float, block_rows: int | None = None) -> DataFrame:
    """vectors(id, vector) -> a, b, score for all pairs a < b with cosine >= threshold; a tile of pairs at a time leaves a task."""

    def run(left, right):
        for p, q, score in pairs(left, right, threshold):
            swap = left.rank[p] > right.rank[q]
            a, b = left.ids.take(pa.array(p)), right.ids.take(pa.array(q))
            first, second = (a, b) if not swap.any() else (pa.compute.if_else(pa.array(swap), b, a), pa.compute.if_else(pa.array(swap), a, b))
            yield pa.RecordBatch.from_arrays([first, second, pa.array(score)], ["a", "b", "score"])

    t = _type(vectors)
    return by_pairs(vectors.select("id", "vector"), run, f"a {t}, b {t}, score double", block_rows)


def _best(row, other, key, score, top: int) -> tuple:
    """The top entries of each row by key (greatest first), then by other."""
    order = np.lexsort((other, -key, row))
    row, other, key, score = row[order], other[order], key[order], score[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    nth = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    keep = nth < top
    return row[keep], other[keep], key[keep], score[keep], nth[keep]


def top_pairs(vectors: DataFrame, threshold: float, top: int) -> DataFrame:
    """a, b, score: the top of each vector among its pairs over the threshold, by rounded score, then by b, at most `top` a task and vector."""

    def side(rows: int):
        """Candidates of one side; the least score that still counts rises as lists fill up."""
        state = [np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)]
        bound = np.full(rows, -np.inf)

        def put(row, other, score):
            state[:] = [np.concatenate(x) for x in zip(state, (row, other, np.round(score, 6), score), strict=True)]
            if len(state[0]) > 3 * top * rows + 100_000:
                done()

        def done():
            *state[:], nth = _best(*state, top)
            full = nth == top - 1
            bound[state[0][full]] = state[2][full] - 1e-6
            return state

        return put, done, bound

    def run(left, right):
        (put_l, done_l, bound_l), (put_r, done_r, bound_r) = side(len(left)), side(len(right))
        order = lambda block: np.argsort(block.rank, kind="stable")
        rank_l, rank_r = left.rank, right.rank
        back = np.zeros(max([-1, *rank_l.tolist(), *rank_r.tolist()]) + 1, int)
        for r, c, s, mask in tiles(left, right, threshold):
            for put, bound, mine, rank, flip in ((put_l, bound_l[r : r + TILE[0], None], r, rank_r, False), (put_r, bound_r[None, c : c + TILE[1]], c, rank_l, True)):
                p, q = np.nonzero(mask & (s >= bound))
                x = s[p, q]
                put(*((q + mine, rank[p + r], x) if flip else (p + mine, rank[q + c], x)))
        for done, mine, other in ((done_l, left, right), (done_r, right, left)):
            row, rank, _, score = done()
            back[other.rank] = np.arange(len(other))
            yield pa.RecordBatch.from_arrays([mine.ids.take(pa.array(row)), other.ids.take(pa.array(back[rank])), pa.array(score)], ["a", "b", "score"])

    t = _type(vectors)
    return by_pairs(vectors.select("id", "vector"), run, f"a {t}, b {t}, score double")


class _Moments:
    """Number, mean, squared distances from it, least and greatest of many values."""

    def __init__(self):
        self.n, self.mean, self.m2, self.low, self.high = 0, 0.0, 0.0, np.inf, -np.inf

    def add(self, x: np.ndarray) -> None:
        n, mean = len(x), float(x.mean())
        d, all_n = mean - self.mean, self.n + n
        self.m2 += float(((x - mean) ** 2).sum()) + d * d * self.n * n / all_n
        self.mean += d * n / all_n
        self.n, self.low, self.high = all_n, min(self.low, float(x.min())), max(self.high, float(x.max()))


def profile(vectors: DataFrame, threshold: float) -> DataFrame:
    """vectors(id, vector, g: bigint) -> kind, id, g1, g2, n, w, mean, m2, low, high, checkpointed.

    'node': a vector's n pairs and w, those of them with a vector of its own g. 'group': the pairs between g1 <= g2 and w, the sum
    of their scores within 0 to 1. 'all': one row of all pairs, with the moments of those scores.
    """
    names = ["kind", "id", "g1", "g2", "n", "w", "mean", "m2", "low", "high"]
    t = _type(vectors)
    schema = f"kind string, id {t}, g1 bigint, g2 bigint, n bigint, w double, mean double, m2 double, low double, high double"

    def batch(kind, size, **given):
        types = pa.schema([("kind", pa.string()), ("id", given["id"].type if "id" in given else pa.null()), ("g1", pa.int64()), ("g2", pa.int64()), ("n", pa.int64()), *((k, pa.float64()) for k in names[5:])])
        return [pa.array([kind] * size)] + [given[k] if k in given else pa.nulls(size, types.field(k).type) for k in names[1:]]

    def run(left, right):
        sides = [left] if left is right else [left, right]
        n, same, m = [np.zeros(len(x), np.int64) for x in sides], [np.zeros(len(x)) for x in sides], _Moments()
        gs = [x.table.column("g").combine_chunks() for x in (left, right)]
        values = np.unique(np.concatenate([g.drop_null().to_numpy() for g in gs]))
        known = [g.is_valid().to_numpy(zero_copy_only=False) for g in gs]
        code = [np.searchsorted(values, g.fill_null(0).to_numpy()) for g in gs]
        k = len(values) + 1
        code = [np.where(ok, c, k - 1) for c, ok in zip(code, known, strict=True)]
        counts: dict = {}
        dense = (np.zeros(k * k, np.int64), np.zeros(k * k)) if k * k <= 1_000_000 else None
        for p, q, score in pairs(left, right, threshold):
            w = np.clip(score, 0.0, 1.0)
            a, b = code[0][p], code[1][q]
            own = (a == b) & (a < k - 1)
            for i, at in ((0, p), (len(sides) - 1, q)):
                n[i] += np.bincount(at, minlength=len(sides[i]))
                same[i] += np.bincount(at[own], minlength=len(sides[i]))
            m.add(w)
            both = np.minimum(a, b).astype(np.int64) * k + np.maximum(a, b)
            if dense:
                dense[0][:] += np.bincount(both, minlength=k * k)
                dense[1][:] += np.bincount(both, w, minlength=k * k)
            else:
                u, inv = np.unique(both, return_inverse=True)
                for x, c, y in zip(u.tolist(), np.bincount(inv).tolist(), np.bincount(inv, w).tolist(), strict=True):
                    old = counts.get(x, (0, 0.0))
                    counts[x] = (old[0] + c, old[1] + y)
        if not m.n:
            return
        if dense:
            hit = np.flatnonzero(dense[0])
            counts = {int(x): (int(dense[0][x]), float(dense[1][x])) for x in hit}
        id_null = left.ids.type
        value = lambda c: int(values[c]) if c < k - 1 else None
        rows = [batch("group", len(counts), id=pa.nulls(len(counts), id_null), g1=pa.array([value(x // k) for x in counts], pa.int64()), g2=pa.array([value(x % k) for x in counts], pa.int64()), n=pa.array([c for c, _ in counts.values()], pa.int64()), w=pa.array([y for _, y in counts.values()], pa.float64()))]
        rows += [batch("node", int((c > 0).sum()), id=x.ids.filter(pa.array(c > 0)), n=pa.array(c[c > 0]), w=pa.array(s[c > 0])) for x, c, s in zip(sides, n, same, strict=True)]
        one = lambda x: pa.array([x], pa.float64())
        rows.append(batch("all", 1, id=pa.nulls(1, id_null), n=pa.array([m.n], pa.int64()), mean=one(m.mean), m2=one(m.m2), low=one(m.low), high=one(m.high)))
        for r in rows:
            yield pa.RecordBatch.from_arrays(r, names)

    raw = by_pairs(vectors.select("id", "vector", F.col("g").cast("bigint").alias("g")), run, schema)
    # moments of parts: squared distances from the mean of all = those within the parts + those of their means
    n = F.col("n")
    whole = raw.groupBy("kind", "id", "g1", "g2").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), (F.sum(F.col("mean") * n) / F.sum("n")).alias("mean"), F.sum("m2").alias("within"), F.sum(n * F.col("mean") * F.col("mean")).alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    spread = F.greatest(F.lit(0.0), F.col("within") + F.col("squares") - F.col("n") * F.col("mean") * F.col("mean"))
    return checkpointed(whole.select("kind", "id", "g1", "g2", "n", "w", "mean", spread.alias("m2"), "low", "high"))


def products(vectors: DataFrame, threshold: float) -> int:
    """vectors(id, vector, d: bigint) -> the sum of d * d over all pairs."""

    def run(left, right):
        x, y = left.column("d"), right.column("d")
        total = sum(int((x[p] * y[q]).sum()) for p, q, _ in pairs(left, right, threshold))
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], ["s"])

    return sum(int(r[0]) for r in by_pairs(vectors, run, "s string").collect())


# Bins of the first pass over the scores; the second one keeps only the scores in the bins of a quartile.
FINE_BINS = 65_536


def distribution(vectors: DataFrame, threshold: float, bins: int = 10) -> DataFrame:
    """vectors.distribution() of the scores of all pairs, without their rows: a histogram, then the bins that hold the quartiles."""
    spark = vectors.sparkSession
    v = vectors.select("id", "vector")
    width = (1.0 + 1e-9 - (threshold - 1e-9)) / FINE_BINS
    fine = lambda x: np.clip(((x - (threshold - 1e-9)) / width).astype(np.int64), 0, FINE_BINS - 1)

    def first(left, right):
        m, h = _Moments(), np.zeros(FINE_BINS, np.int64)
        for _, _, s in pairs(left, right, threshold):
            m.add(s)
            h += np.bincount(fine(s), minlength=FINE_BINS)
        hit = np.flatnonzero(h)
        if len(hit):
            none = pa.nulls(len(hit) - 1, pa.float64())
            one = lambda x: pa.concat_arrays([pa.array([x], pa.float64()), none])
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(h[hit]), pa.concat_arrays([pa.array([m.n]), pa.nulls(len(hit) - 1, pa.int64())]), one(m.mean), one(m.m2), one(m.low), one(m.high)], ["bin", "n", "all", "mean", "m2", "low", "high"])

    raw = checkpointed(by_pairs(v, first, "bin bigint, n bigint, all bigint, mean double, m2 double, low double, high double"))
    parts = [r for r in raw.where("all is not null").select("all", "mean", "m2", "low", "high").collect()]
    schema = "bin int, bin_count bigint, n bigint, mean double, median double, std double, low double, high double, q1 double, q3 double"
    if not parts:
        return spark.createDataFrame([], schema)
    n = sum(r["all"] for r in parts)
    mean = sum(r["all"] * r["mean"] for r in parts) / n
    m2 = sum(r["m2"] + r["all"] * (r["mean"] - mean) ** 2 for r in parts)
    low, high = min(r["low"] for r in parts), max(r["high"] for r in parts)
    counts = np.zeros(FINE_BINS, np.int64)
    for r in raw.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    upto = np.cumsum(counts)
    # the value between two neighbours in order: both are wanted
    at = {q: q * (n - 1) for q in (0.25, 0.5, 0.75)}
    wanted = sorted({i for x in at.values() for i in (int(np.floor(x)), int(np.ceil(x)))})
    held = sorted({int(np.searchsorted(upto, i, side="right")) for i in wanted})

    def second(left, right):
        h = np.zeros(bins, np.int64)
        for _, _, s in pairs(left, right, threshold):
            h += np.bincount(np.minimum(bins - 1, np.floor((s - low) / (high - low) * bins).astype(np.int64)) if high > low else np.zeros(len(s), np.int64), minlength=bins)
            f = fine(s)
            for b in held:
                x = s[f == b]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), b)), pa.nulls(len(x), pa.int64()), pa.array(x)], ["bin", "n", "s"])
        hit = np.flatnonzero(h)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(h[hit]), pa.nulls(len(hit), pa.float64())], ["bin", "n", "s"])

    again = checkpointed(by_pairs(v, second, "bin bigint, n bigint, s double"))
    value: dict = {}
    for b in held:
        before = int(upto[b] - counts[b])
        places = [i for i in wanted if before <= i < upto[b]]
        # the sorted values are read up to the places wanted, in one pass of the bin
        ordered = again.where((F.col("bin") == b) & F.col("s").isNotNull()).groupBy("s").agg(F.count("*").alias("c")).orderBy("s")
        seen, left = before, list(places)
        for r in ordered.toLocalIterator():
            while left and left[0] < seen + r["c"]:
                value[left.pop(0)] = r["s"]
            seen += r["c"]
            if not left:
                break
    point = {q: value[int(np.floor(x))] + (x - np.floor(x)) * (value[int(np.ceil(x))] - value[int(np.floor(x))]) for q, x in at.items()}
    six = lambda x: F.round(F.lit(float(x)), 6)
    per = again.where("n is not null").groupBy(F.col("bin").cast("int").alias("bin")).agg(F.sum("n").alias("bin_count"))
    return per.select("bin", "bin_count", F.lit(n).cast("bigint").alias("n"), six(mean).alias("mean"), six(point[0.5]).alias("median"), six(np.sqrt(m2 / n)).alias("std"), F.lit(low).alias("low"), F.lit(high).alias("high"), six(point[0.25]).alias("q1"), six(point[0.75]).alias("q3"))


def triangles(vectors: DataFrame, threshold: float) -> DataFrame:
    """id, triangles among the pairs over the threshold.

    Each pair of the blocks I and J is met with the neighbours of both in a third block K, as rows of bits; half of the sum over
    a vector's pairs are its triangles. A task holds three blocks, and bits for PART columns of K at a time.
    """
    n = vectors.count()
    blocks = max(1, -(-n // TRIPLE_ROWS), min(4, -(-n // 2000)))
    meets = [(i, j, k) for i, j in combinations_with_replacement(range(blocks), 2) for k in range(blocks)]
    part = 8192

    def bits(rows: Block, third: Block, lo: int) -> np.ndarray:
        x = third.x[lo : lo + part]
        out = np.zeros((len(rows), -(-len(x) // 64)), np.uint64)
        for r in range(0, len(rows), TILE[0]):
            near = rows.x[r : r + TILE[0]] @ x.T >= threshold - 1e-12
            near &= rows.rank[r : r + TILE[0], None] != third.rank[None, lo : lo + part]
            packed = np.packbits(near, axis=1)
            out.view(np.uint8).reshape(len(rows), -1)[r : r + TILE[0], : packed.shape[1]] = packed
        return out

    def run(left, right, third):
        total = [np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)]
        for lo in range(0, len(third), part):
            a = bits(left, third, lo)
            b = a if right is left else bits(right, third, lo)
            for p, q, _ in pairs(left, right, threshold):
                for s in range(0, len(p), 8192):
                    x, y = p[s : s + 8192], q[s : s + 8192]
                    both = a.take(x, axis=0)
                    both &= b.take(y, axis=0)
                    c = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
                    total[0] += np.bincount(x, c, minlength=len(left)).astype(np.int64)
                    total[1] += np.bincount(y, c, minlength=len(right)).astype(np.int64)
        for block, t in zip((left, right), total, strict=True):
            yield pa.RecordBatch.from_arrays([block.ids.filter(pa.array(t > 0)), pa.array(t[t > 0])], ["id", "n"])

    found = _met(vectors.select("id", "vector"), blocks, meets, run, f"id {_type(vectors)}, n bigint")
    return found.groupBy("id").agg((F.sum("n") / 2).cast("bigint").alias("triangles"))
