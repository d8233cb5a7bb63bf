"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its doc_id. Tokens are summed by
source and by the leading bits of the hash; a running sum over these buckets
finds, for every source and budget, the bucket in which the budget is used up.
Only that boundary bucket is split by the next bits, until it holds a single
hash. What is left is one threshold per source and budget, and documents are
kept by comparing their hash with it: no sort of documents, and a document kept
under a small budget is kept under every larger one.

Defined results
  * A source's budget is ``weight * total / sum of weights`` tokens, where total is
    ``fraction`` of all tokens; a source that has less gives all it has.
  * The documents kept are the longest run in hash order whose tokens stay within
    the budget. Documents of equal hash (repeated rows of a doc_id, null doc_ids)
    stay or go together.
  * Null text and empty text count 0 tokens. A null source is a source of its own,
    with the default weight. Weights that are not listed are ``default_weight``. Where
    all weights are 0, so are all budgets, and documents of 0 tokens alone may stay.
  * An empty table gives an empty table. Extra columns pass through untouched. Texts of
    any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.common import read, removed, written

#: Production parameters: relative weights, share of all tokens to keep, nested budgets in quarters of it.
WEIGHTS = {"src0": 8}
DEFAULT_WEIGHT = 1
FRACTION = (4, 5)
TIERS = ((1, 4), (1, 2), (1, 1))

HASH_BITS, LEVEL_BITS = 60, 12
TOKEN = "[^ \\t\\n\\r\\x0B\\f]+"


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the decimal doc_id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, hash and tokens of every document: the only pass over the texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), doc_hash(F.col("doc_id")).alias("h"), n_tokens(F.col("text").cast("string")).alias("n_tokens"))


def thresholds(sizes: DataFrame, weights: dict[str, int], default_weight: int, fraction: tuple[int, int], tiers: tuple[tuple[int, int], ...], states: list[DataFrame] | None = None) -> DataFrame:
    """source, tier, threshold: tier i keeps the documents of the source whose hash is below. ``states`` gets the tables written on the way."""
    spark = sizes.sparkSession
    weight = F.lit(default_weight).cast("long")
    if weights:
        listed = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        weight = F.coalesce(F.when(F.col("source").isNotNull(), F.try_element_at(listed, F.col("source"))), F.lit(default_weight)).cast("long")
    supply = sizes.groupBy("source").agg(F.sum("n_tokens").alias("supply")).withColumn("weight", weight)
    total = supply.agg(F.sum("supply").alias("total"), F.sum("weight").alias("weights"))
    steps = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("tier"), F.lit(n).cast("long").alias("num"), F.lit(d).cast("long").alias("den")) for i, (n, d) in enumerate(tiers)]))
    budget = F.expr(f"coalesce(weight * (total * {fraction[0]} div {fraction[1]}) div nullif(weights, 0L), 0L) * num div den")
    # An open row is a range of hashes of one source in which the budget `rest` runs out, or beyond it.
    open_ = written(supply.crossJoin(total).select("source", "supply", "weight", "total", "weights", steps.alias("s")).select("source", "supply", "weight", "total", "weights", "s.*").select("source", "tier", F.least("supply", budget).alias("rest"), F.lit(0).cast("long").alias("prefix")), "mix-budgets")
    done: DataFrame | None = None
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        here = sizes.select("source", "n_tokens", "h", F.shiftright("h", shift + LEVEL_BITS).alias("prefix"), F.shiftright("h", shift).alias("bucket"))
        s, o = here.alias("s"), open_.select("source", "prefix").distinct().alias("o")
        if level:
            s = s.join(F.broadcast(o) if _small(open_) else o, F.col("s.source").eqNullSafe(F.col("o.source")) & (F.col("s.prefix") == F.col("o.prefix")), "left_semi")
        histogram = s.groupBy("source", "prefix", "bucket").agg(F.sum("n_tokens").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        running = histogram.withColumn("upto", F.sum("n").over(W.partitionBy("source", "prefix").orderBy("bucket"))).alias("r")
        # The first bucket that exceeds the budget is the boundary.
        over = running.join(open_.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.prefix") == F.col("o.prefix")) & (F.col("r.upto") > F.col("o.rest")))
        first = over.groupBy(F.col("o.source").alias("source"), "tier").agg(F.min(F.struct("bucket", F.expr("rest - (upto - n)").alias("rest"), "low", "high")).alias("b"))
        state = written(first.select("source", "tier", "b.*"), f"mix-level{level}")
        if states is not None:
            states.append(state)
        single = F.col("low") == F.col("high")
        found = state.filter(single).select("source", "tier", F.col("low").alias("threshold"))
        done = found if done is None else done.unionByName(found)
        open_ = state.filter(~single).select("source", "tier", "rest", F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
    every = supply.select("source").crossJoin(spark.range(1, len(tiers) + 1).select(F.col("id").cast("int").alias("tier"))).alias("e")
    found = done.alias("d")
    # No boundary: the budget covers the whole source.
    return every.join(found, F.col("e.source").eqNullSafe(F.col("d.source")) & (F.col("e.tier") == F.col("d.tier")), "left").select("e.source", "e.tier", F.coalesce("threshold", F.lit(1 << HASH_BITS)).alias("threshold"))


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether there are so few rows that a broadcast is safe."""
    return df.limit(rows + 1).count() <= rows


def mix(docs: DataFrame, weights: dict[str, int] = WEIGHTS, default_weight: int = DEFAULT_WEIGHT, fraction: tuple[int, int] = FRACTION, tiers: tuple[tuple[int, int], ...] = TIERS) -> tuple[DataFrame, DataFrame]:
    """The sizes of all documents, and per source the array of its tiers' thresholds."""
    sizes = written(sizes_of(docs), "mix-sizes")
    states: list[DataFrame] = []
    by_source = thresholds(sizes, weights, default_weight, fraction, tiers, states).groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("tier", "threshold"))), lambda x: x["threshold"]).alias("limits"))
    limits = written(by_source, "mix-thresholds")
    removed(*states)
    return sizes, limits


def _within(limits: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``row`` of those of ``rows`` (row, source, h) whose hash is below the largest threshold of their source, and ``tier``."""
    small = _small(limits)
    joined = rows.alias("r").join((F.broadcast(limits) if small else limits).alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")))
    tier = F.size("l.limits") - F.size(F.filter("l.limits", lambda x: F.col("r.h") < x)) + 1
    return joined.select("r.row", tier.alias("tier"), F.size("l.limits").alias("n")).filter("tier <= n").select("row", "tier")


def tiers_of(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens and tier (the smallest budget that has it) of the documents that stay."""
    packed = sizes.select(F.struct("doc_id", "source", "n_tokens").alias("row"), "source", "h")
    return _within(limits, packed).select("row.*", F.col("tier").cast("long").alias("tier"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents within the full budget of their source, with all their columns, whatever their names."""
    sizes, limits = mix(docs, **parameters)
    removed(sizes)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["source"].cast("string").alias("source"), doc_hash(docs["doc_id"]).alias("h"))
    return _within(limits, packed).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, limits = mix(read(spark, sf_dir, "documents"))
    return tiers_of(sizes, limits)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\x0B\\f]+'))::BIGINT AS n_tokens,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(n_tokens)::HUGEINT AS supply, CASE WHEN source = 'src0' THEN 8 ELSE 1 END AS w FROM d GROUP BY 1),
t AS (SELECT sum(supply) AS total, sum(w) AS ws FROM s),
c AS (SELECT d.*, sum(n_tokens) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM d),
b AS (SELECT source, tier, least(supply, w * (total * {FRACTION[0]} // {FRACTION[1]}) // ws * num // den) AS budget
      FROM s, t, (VALUES (1, 1, 4), (2, 1, 2), (3, 1, 1)) AS x(tier, num, den))
SELECT doc_id, c.source, n_tokens, min(tier)::BIGINT AS tier
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND upto <= budget
GROUP BY ALL
"""
