"""Problem 8: filling fixed-capacity containers with texts.

For each capacity a global histogram of item sizes (at most one count per size up to the capacity) is made in one
aggregation.  Dynamic programming over it chooses length buckets that minimise padding.  Inside each bucket, batches of
as many items as the token budget holds are formed; what such a batch leaves free is filled with batches of the
next smaller buckets that fit.  The plan is a short list of patterns with multiplicities; items find their container by
their rank in their bucket, which is counted in chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.tokens import VOCAB, with_token_count
from annalist.session import cut

#: Length buckets per capacity.
BUCKETS = 256
#: Chunks in which the items of one bucket are numbered.
RANK_CHUNKS = 256


def bucket_bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper bounds of the length buckets with the least total padding (``sizes`` ascending and distinct).

    The cost of a bucket over sizes i+1..j is bound * items - tokens.  As a function of i that is a line in the bound, so
    a layer is the lower envelope of lines; the best i moves monotonically with j, and all middles of one depth of the
    halving are solved at once.
    """
    m = len(sizes)
    if m <= buckets:
        return sizes.copy()
    n = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    s = np.concatenate([[0], np.cumsum(counts * sizes)]).astype(float)
    bound = np.concatenate([[0], sizes]).astype(float)
    # The first layer is one bucket over sizes 1..j.
    best = bound * n - s
    came = np.zeros((buckets + 1, m + 1), dtype=np.int32)
    for k in range(2, buckets + 1):
        best, came[k] = _layer(best, n, s, bound)
    out, j = [], m
    for k in range(buckets, 0, -1):
        out.append(j)
        j = int(came[k, j])
        if j == 0:
            break
    return sizes[np.array(sorted(out)) - 1]


def _layer(best: np.ndarray, n: np.ndarray, s: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min over i < j of best[i] + bound[j] * (n[j] - n[i]) - (s[j] - s[i]), and the first such i, for all j."""
    m = len(best) - 1
    g = best + s
    new, came = np.zeros(m + 1), np.zeros(m + 1, dtype=np.int32)
    # Open stretches lo..hi of j, with the i that may be best for them: first[lo - 1] and last[hi + 1] bound them.
    lo, hi = np.array([1]), np.array([m])
    a, b = np.array([0]), np.array([m - 1])
    while len(lo):
        mid = (lo + hi) // 2
        top = np.minimum(b, mid - 1)
        size = top - a + 1
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        i = np.arange(int(size.sum())) + np.repeat(a - start, size)
        cost = g[i] - np.repeat(bound[mid], size) * n[i]
        least = np.minimum.reduceat(cost, start)
        hit = np.flatnonzero(cost == np.repeat(least, size))
        at = i[hit[np.searchsorted(hit, start)]]
        new[mid], came[mid] = least + bound[mid] * n[mid] - s[mid], at
        left, right = lo < mid, mid < hi
        lo, hi, a, b = np.concatenate([lo[left], mid[right] + 1]), np.concatenate([mid[left] - 1, hi[right]]), np.concatenate([a[left], at[right]]), np.concatenate([at[left], b[right]])
    return new, came


def fill_plan(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (containers, [(bucket, items per container)]) that use up all items.

    Each pattern starts with a batch of the largest bucket that has items left and tops it up with the largest buckets
    that still fit.  Every pattern uses up at least one bucket or the last partial batch of one, so there are at most
    about twice as many patterns as buckets times their tops.
    """
    left = list(counts)
    plan: list[tuple[int, list[tuple[int, int]]]] = []
    k = len(bounds) - 1
    while k >= 0:
        if not left[k]:
            k -= 1
            continue
        room, uses = capacity, []
        for j in range(k, -1, -1):
            size = max(bounds[j], 1)
            if left[j] and size <= room and (q := min(room // size, left[j])):
                uses.append((j, q))
                room -= q * size
        times = min(left[j] // q for j, q in uses)
        for j, q in uses:
            left[j] -= q * times
        plan.append((times, uses))
    return plan


def items(documents: DataFrame, budgets: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """Pieces of every document for every budget: ``budget``, ``capacity``, ``doc_id``, ``part``, ``start_token``,
    ``n_tokens``, ``whole`` (the piece fills a container by itself).

    A text is divided only if it alone exceeds the capacity: into pieces of the capacity and one rest.  Null and empty
    texts are pieces of 0 tokens.  Budgets without a positive capacity are left out.
    """
    n = cut(with_token_count(documents.select("doc_id", "text"), "text", "tokens", vocab).select("doc_id", "tokens"), "tokens")
    caps = budgets.where("capacity_tokens > 0").groupBy("budget").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    # The capacities are a short configuration table: each document is wanted once per capacity.
    caps_list = [(r["budget"], r["capacity"]) for r in caps.collect()]
    if not caps_list:
        return n.select(F.lit("").alias("budget"), F.lit(0).cast("bigint").alias("capacity"), "doc_id", F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("start_token"), F.col("tokens").alias("n_tokens"), F.lit(False).alias("whole")).limit(0)
    wanted = F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(c).cast("bigint").alias("capacity")) for b, c in caps_list])
    d = n.select("doc_id", "tokens", F.inline(wanted))
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.expr("(tokens - 1) div capacity")))))
    d = d.withColumn("start_token", F.col("part") * F.col("capacity")).withColumn("n_tokens", F.least(F.col("capacity"), F.col("tokens") - F.col("start_token")))
    return d.select("budget", "capacity", "doc_id", "part", "start_token", "n_tokens", (F.col("n_tokens") == F.col("capacity")).alias("whole"))


def pack(documents: DataFrame, budgets: DataFrame, buckets: int = BUCKETS, vocab: str = VOCAB) -> DataFrame:
    """Each piece with its ``container``; the pieces of a container never exceed its capacity.

    Columns ``budget``, ``container``, ``doc_id``, ``part``, ``start_token``, ``n_tokens``.
    """
    spark = documents.sparkSession
    d = items(documents, budgets, vocab)
    cols = ["budget", "container", "doc_id", "part", "start_token", "n_tokens"]
    full = d.where("whole").withColumn("container", F.concat_ws(":", "budget", F.lit("full"), "doc_id", "part")).select(*cols)
    rest = d.where("NOT whole")
    # At most one row per size below the capacities.
    histogram: dict[tuple[str, int], dict[int, int]] = {}
    for r in rest.groupBy("budget", "capacity", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram.setdefault((r["budget"], r["capacity"]), {})[r["n_tokens"]] = r["n"]
    size_rows: list[tuple[str, int, int]] = []
    segments: list[tuple[str, int, int, int, int, int]] = []
    for (budget, capacity), h in histogram.items():
        sizes = np.array(sorted(h))
        counts = np.array([h[x] for x in sorted(h)])
        bounds = bucket_bounds(sizes, counts, buckets)
        of = np.searchsorted(bounds, sizes)
        size_rows += [(budget, int(x), int(b)) for x, b in zip(sizes, of)]
        n = np.bincount(of, weights=counts, minlength=len(bounds)).astype(np.int64)
        base, used = 0, [0] * len(bounds)
        for times, uses in fill_plan([int(b) for b in bounds], [int(x) for x in n], capacity):
            for j, q in uses:
                segments.append((budget, j, used[j], used[j] + q * times, q, base))
                used[j] += q * times
            base += times
    if not segments:
        return full
    # Both tables are bounded by the capacities and the number of buckets, not by the documents.
    size_table = spark.createDataFrame(pa.table({"budget": [x[0] for x in size_rows], "n_tokens": pa.array([x[1] for x in size_rows], pa.int64()), "bucket": pa.array([x[2] for x in size_rows], pa.int64())}))
    names = ("budget", "bucket", "first", "past", "per", "base")
    segment_table = spark.createDataFrame(pa.table({c: [x[i] for x in segments] if i == 0 else pa.array([x[i] for x in segments], pa.int64()) for i, c in enumerate(names)}))
    rest = rest.join(F.broadcast(size_table), ["budget", "n_tokens"]).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "part"), F.lit(RANK_CHUNKS)))
    keys = ["budget", "bucket", "chunk"]
    n = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = n.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("budget", "bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rest = rest.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "part")) - 1).join(F.broadcast(before), keys)
    rest = rest.withColumn("r", F.col("r") + F.col("before"))
    rest = rest.join(F.broadcast(segment_table), ["budget", "bucket"]).where("r >= first AND r < past")
    rest = rest.withColumn("container", F.concat_ws(":", "budget", F.lit("mix"), F.expr("base + (r - first) div per")))
    return full.unionByName(rest.select(*cols))


def report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: containers, tokens, share of the room that is filled, and the fewest containers that could do."""
    c = packed.groupBy("budget", "container").agg(F.sum("n_tokens").alias("t"))
    d = c.groupBy("budget").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("largest"))
    caps = budgets.groupBy("budget").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    d = d.join(caps, "budget")
    return d.select("budget", "capacity", "n_containers", "n_tokens", "largest", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("filled"), F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"))


def checks(packed: DataFrame, documents: DataFrame, budgets: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """Per budget how often what a packing promises fails: ``n_docs`` packed, ``n_over`` containers above their capacity, and
    documents that are ``n_missing``, have pieces twice, apart or of other tokens than their text (``n_broken``), or were
    divided without need (``n_divided``)."""
    caps = budgets.where("capacity_tokens > 0").groupBy("budget").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    over = packed.groupBy("budget", "container").agg(F.sum("n_tokens").alias("t")).join(F.broadcast(caps), "budget").groupBy("budget").agg(F.count_if(F.col("t") > F.col("capacity")).alias("n_over"))
    own = with_token_count(documents.select("doc_id", "text"), "text", "tokens", vocab).select("doc_id", "tokens")
    # Each document once per budget; budgets are a short configuration table.
    wanted = own.select("doc_id", "tokens", F.explode(F.array(*[F.lit(r["budget"]) for r in caps.select("budget").collect()]).cast("array<string>")).alias("budget"))
    d = packed.join(F.broadcast(caps), "budget").groupBy("budget", "doc_id").agg(F.count(F.lit(1)).alias("parts"), (F.max("part") + 1).alias("last"), F.sum("n_tokens").alias("t"), F.count_if(F.col("start_token") != F.col("part") * F.col("capacity")).alias("apart"), F.max("capacity").alias("capacity"))
    d = wanted.join(d, ["budget", "doc_id"], "left")
    broken = (F.col("parts") != F.col("last")) | (F.col("t") != F.col("tokens")) | (F.col("apart") > 0)
    d = d.groupBy("budget").agg(F.count("parts").alias("n_docs"), F.count_if(F.col("parts").isNull()).alias("n_missing"), F.count_if(broken).alias("n_broken"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("n_divided"))
    return d.join(over, "budget").select("budget", "n_docs", "n_over", "n_missing", "n_broken", "n_divided")
