"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is allocated in blocks of equal token counts. Sources compete for the
next block with quotients weight / (2 * blocks + 1); the highest quotient wins.
That gives integer quotas per source, and the same rule deals a source's quota
to its shards. Inside a shard the documents stand in a seeded order, and a
seeded run of consecutive blocks is taken, so a document is taken whole but for
the two at the run's ends.

Per-source and per-shard totals are the only figures on the driver: sources are
a catalogue (tens to many thousands), and shards grow with the corpus once there
would be more than `most_shards` of them. Document rows never leave the
executors, and a source is never gathered in one task: its shards are, as narrow
rows that a window sorts and streams.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._spark import cut, n_words, table

BLOCK = 32
#: Words of a shard; a mix of more than MOST_SHARDS such shards has larger ones.
SHARD_WORDS = 4_000_000
MOST_SHARDS = 65_536
REPEAT = 3
SEED = "mix-1"


def targets(sizes: list[int], weights: list[int], budget: int, repeat: int = REPEAT) -> list[tuple[int, int]]:
    """Shares of the budget by weight, none above repeat * size, as fractions (numerator, denominator).

    The excess of capped sources is dealt to the others by weight until none is
    above: filling by rising level, so sources are capped in the order of
    size / weight and one pass over that order suffices.
    """
    left, weight = budget, sum(w for s, w in zip(sizes, weights, strict=True) if s)
    out: list[tuple[int, int]] = [(0, 1)] * len(sizes)
    order = sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: (Fraction(sizes[i], weights[i]), i))
    for n, i in enumerate(order):
        if repeat * sizes[i] * weight <= left * weights[i]:
            out[i] = (repeat * sizes[i], 1)
            left, weight = left - repeat * sizes[i], weight - weights[i]
        else:
            for j in order[n:]:
                out[j] = (left * weights[j], weight)
            break
    return out


def sainte_lague(weights: list[int], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotients w / (2k + 1), ties to the earlier claimant, none above its cap.

    A divisor found by bisection gives all but a few seats at once, whatever
    their number; the last ones are dealt one by one with exact quotients.
    """
    w, cap = np.array(weights, dtype=np.float64), np.array(caps, dtype=np.float64)
    seats = int(min(seats, sum(caps)))
    if seats <= 0 or not len(weights):
        return [0] * len(weights)

    def dealt(theta: float) -> np.ndarray:
        return np.minimum(np.floor((w / theta + 1) / 2), cap)

    low, high = w[w > 0].min() / (2.0 * seats + 3) / 4, 2 * w.max()
    for _ in range(200):
        mid = (low + high) / 2
        if dealt(mid).sum() > seats:
            low = mid
        else:
            high = mid
    won = [max(0, int(x) - 1) for x in dealt(high)]
    heap = [(-Fraction(weights[i], 2 * won[i] + 1), i) for i in range(len(weights)) if won[i] < caps[i] and weights[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(won)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        won[i] += 1
        if won[i] < caps[i]:
            heapq.heappush(heap, (-Fraction(weights[i], 2 * won[i] + 1), i))
    return won


def mix_plan(sources: list[tuple[str | None, int]], block: int = BLOCK, repeat: int = REPEAT) -> list[dict]:
    """Targets and quotas of sources given as (name, size) in code-point order, null last."""
    ranked = sorted(sources, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    sizes, weights = [s for _, s in ranked], [1 + k % 3 for k in range(len(ranked))]
    budget = sum(sizes)
    share = targets(sizes, weights, budget, repeat)
    blocks = sainte_lague(weights, [repeat * s // block for s in sizes], round(budget / block))
    return [{"source": n, "source_size": s, "weight": w, "target": t[0] / t[1], "quota": q * block} for (n, s), w, t, q in zip(ranked, weights, share, blocks, strict=True)]


def _key(*parts) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *parts))


def _low32(md5) -> F.Column:
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, block: int = BLOCK, repeat: int = REPEAT, shard_words: int = SHARD_WORDS, most_shards: int = MOST_SHARDS) -> DataFrame:
    """docs(doc_id, source, size) with source_size, target and taken.

    Defined results: null sources form one source of their own, the last; empty
    documents take 0; equal rows may share what the run takes of them in any
    order, but the sums stay; an empty table gives an empty table. A source is
    within one block and what its last, partial block holds of its target.
    """
    spark = docs.sparkSession
    base = cut(docs.select("doc_id", "source", F.col("size").cast("long").alias("size"), _key(F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias("key")), "mix")
    plan = mix_plan([(r["source"], int(r["s"])) for r in base.groupBy("source").agg(F.sum("size").alias("s")).collect()], block, repeat)
    shard_words = max(shard_words, -(-sum(p["source_size"] for p in plan) // most_shards))
    for p in plan:
        p["shards"] = max(1, -(-p["source_size"] // shard_words))
    schema = T.StructType([T.StructField("_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_shards", T.IntegerType())])
    by_source = spark.createDataFrame([(p["source"], p["source_size"], p["target"], p["shards"]) for p in plan], schema)
    dealt = base.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_shard", F.when(F.col("_shards") == 1, 0).otherwise(F.pmod(_low32(F.col("key")), F.col("_shards"))).cast("int"))
    by_shard = {}
    for r in dealt.groupBy("source", "_shard").agg(F.sum("size").alias("s")).collect():
        by_shard.setdefault(r["source"], []).append((r["_shard"], int(r["s"])))
    rows = []
    for p in plan:
        own = sorted(by_shard.get(p["source"], []))
        passes = min(repeat, p["quota"] // p["source_size"]) if p["source_size"] else 0
        rest = (p["quota"] - passes * p["source_size"]) // block
        full = [s // block for _, s in own]
        for (shard, _), have, take in zip(own, full, sainte_lague([max(s, 0) for _, s in own], full, rest), strict=True):
            rows.append((p["source"], shard, int(passes), have * block, take * block))
    schema = T.StructType([T.StructField("_s", T.StringType()), T.StructField("_k", T.IntegerType()), T.StructField("_passes", T.LongType()), T.StructField("_have", T.LongType()), T.StructField("_take", T.LongType())])
    quotas = spark.createDataFrame(rows, schema).withColumn("_from", F.when(F.col("_have") == 0, 0).otherwise(F.pmod(_low32(_key(F.coalesce(F.col("_s"), F.lit("")), F.col("_k").cast("string"))), F.expr("_have div %d" % block)) * block).cast("long"))
    end = F.sum("size").over(Window.partitionBy("source", "_shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("_end", end).join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_k")))

    def before(at) -> F.Column:
        """Words that the run [_from, _from + _take), wrapped at _have, has before place `at` of the shard."""
        x = F.least(at, F.col("_have"))
        first = F.greatest(F.lit(0), F.least(x, F.least(F.col("_from") + F.col("_take"), F.col("_have"))) - F.col("_from"))
        wrapped = F.greatest(F.lit(0), F.least(x, F.col("_from") + F.col("_take") - F.col("_have")))
        return first + wrapped

    taken = F.col("_passes") * F.col("size") + before(F.col("_end")) - before(F.col("_end") - F.col("size"))
    return placed.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once for each full size taken, and once more where at least half a size remains.

    Defined results: empty documents aren't taken; equal rows are taken alike;
    null sources are one source; further columns are kept; an empty table gives an
    empty table.
    """
    keep = docs.columns
    # a null is marked, or ("a", null) and (null, "a") would be one row
    row = F.xxhash64(*[x for c in keep for x in (F.col(c).isNull(), F.col(c).cast("string"))])
    sized = docs.select(row.alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    times = mix(sized).groupBy("doc_id").agg(F.max("size").alias("_size"), F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_rows"))
    # equal rows share one key: each of them is repeated for its share of what the key takes
    times = times.select(F.col("doc_id").alias("_key"), F.when(F.col("_size") == 0, 0).otherwise(F.floor(F.col("_taken") / (F.col("_size") * F.col("_rows")) + 0.5)).cast("int").alias("_times")).where("_times > 0")
    own = docs.select(F.struct(*keep).alias("_row"), row.alias("_key"))
    return own.join(times, "_key").select(F.explode(F.expr("array_repeat(_row, _times)")).alias("_row")).select(*[F.col("_row")[c].alias(c) for c in keep])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '?')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 AS w,
         row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) AS r
  FROM d GROUP BY source
), o AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY source_size * 1.0 / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
         sum(w) OVER (ORDER BY source_size * 1.0 / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weight,
         (SELECT sum(source_size) FROM s)::BIGINT AS budget
  FROM s WHERE source_size > 0
), f AS (
  SELECT *, 3 * source_size * weight <= (budget - capped) * w AS full_ FROM o
), l AS (
  SELECT min(CASE WHEN NOT full_ THEN capped END) AS capped, max(CASE WHEN NOT full_ THEN weight END) AS weight FROM f
), t AS (
  SELECT f.source, f.r, f.w, f.source_size, f.budget,
         CASE WHEN full_ THEN (3 * source_size)::DOUBLE ELSE ((budget - l.capped) * w)::DOUBLE / l.weight::DOUBLE END AS target
  FROM f, l
), q AS (
  SELECT r, row_number() OVER (ORDER BY w::DOUBLE / (2 * k + 1) DESC, r) AS n, budget
  FROM (SELECT r, w, budget, unnest(range(0, 3 * source_size // 32)) AS k FROM t)
), won AS (
  SELECT t.*, 32 * coalesce(c.n, 0) AS quota FROM t LEFT JOIN (SELECT r, count(*) AS n FROM q WHERE n <= round_even(budget / 32.0, 0) GROUP BY r) c USING (r)
), p AS (
  SELECT *, least(3, quota // source_size) AS passes, source_size // 32 * 32 AS have,
         least((quota - least(3, quota // source_size) * source_size) // 32, source_size // 32) * 32 AS take
  FROM won
), z AS (
  SELECT *, CASE WHEN have = 0 THEN 0 ELSE (('0x' || substr(md5('mix-1|' || coalesce(source, '') || '|0'), 1, 8))::BIGINT % (have // 32)) * 32 END AS origin
  FROM p
), e AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop FROM d
), x AS (
  SELECT e.doc_id, e.size, coalesce(z.source_size, 0)::BIGINT AS source_size, coalesce(z.target, 0.0) AS target, z.passes, z.have, z.take, z.origin,
         least(stop, have) AS b, least(stop - size, have) AS a
  FROM e LEFT JOIN z ON e.source IS NOT DISTINCT FROM z.source
)
SELECT doc_id, size, source_size, target,
  coalesce(passes * size
    + greatest(0, least(b, origin + take, have) - origin) + greatest(0, least(b, origin + take - have))
    - greatest(0, least(a, origin + take, have) - origin) - greatest(0, least(a, origin + take - have)), 0)::BIGINT AS taken
FROM x
"""
