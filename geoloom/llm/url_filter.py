"""URL filters by a sort-merge range join of nested rules.

A URL becomes a key of its reversed host and its path (``org,example,www,)/a/b``),
a rule a prefix of such keys. All keys with a prefix lie in one interval, and two
intervals are nested or apart. Rules and URLs are cut at the same key boundaries,
found by binary search, and sorted together; one sweep of each piece keeps a stack
of the rules that are open at the present key. The top of the stack is the longest,
which decides. A key so frequent that several boundaries fall on it has as many
pieces, over which its URLs are spread; rules go to every piece that they meet.

Defined results
  * Which scheme a URL has, its port, user and fragment don't matter, nor letter case
    in the host; that of paths and queries does, in URLs and in rules.
  * A domain rule ``example.org`` covers the host and its subdomains; with a path
    (``example.org/a``) it covers only that host's paths that begin so.
  * Of several rules that cover a URL the longest decides; of equal prefixes the
    one with the least rule_id. No rule: ``default_action`` and null rule_id.
  * A null URL, and one without a scheme or a host, is kept with action ``invalid``.
    A rule whose pattern is null is none.
  * Repeated rows and URLs each give a row. Without pages the result is empty; without
    rules all have the default. URLs of any length are taken whole; extra columns of
    either table don't matter.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import read, shared_path

#: Production rules: (rule_id, pattern, action).
RULES = (
    (1, "example.com", "allow"),
    (2, "example.org", "allow"),
    (3, "spam-farm.example.org", "block"),
    (4, "www.spam-farm.example.org/en/", "review"),
    (5, "tionble.example.com", "review"),
    (6, "blog.tionble.example.com/de/", "block"),
    (7, "m.tiontion.example.com", "block"),
    (8, "tionsh.example.net/en/1", "review"),
    (9, "tionsh.example.net/en/13", "block"),
    (10, "tionsh.example.net/en/135", "allow"),
    (11, "ththth.example.org", "review"),
    (12, "blog.ththth.example.org/en/3", "block"),
    (13, "net", "allow"),
    (14, "adult.example.com", "block"),
)
DEFAULT_ACTION = "allow"

#: Sampled keys for each piece; they steer only the balance.
SAMPLED = 200
#: No key has this character, which is above all that keys have.
_LAST = "\U0010ffff"


def _reverse_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(F.lower(host), "[.]")), ","), F.lit(","))


def url_key(url: Column) -> Column:
    """Reversed host, ``)`` and the path with its query; null where there is no host."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*", 0), "^.*@", ""), "(:[0-9]*)?[.]*$", "")
    path = F.regexp_extract(rest, "^[^/?]*(.*)$", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when((host != "") & F.trim(url).rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(_reverse_host(host), F.lit(")"), path))


def rule_prefix(pattern: Column) -> Column:
    """The prefix that all keys under the rule begin with."""
    host = F.regexp_extract(pattern, "^[^/]*", 0)
    path = F.regexp_extract(pattern, "^[^/]*(.*)$", 1)
    return F.when(path == "", _reverse_host(host)).otherwise(F.concat(_reverse_host(host), F.lit(")"), path))


def _sweep(batches):
    """Rows sorted by piece, key and kind (rules before URLs): the deciding rule of each URL."""
    stack: list[tuple[str, int, str]] = []
    piece = None
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in ("piece", "key", "kind", "rule_id", "action")}
        keep, ids, actions = [], [], []
        for i in range(batch.num_rows):
            if c["piece"][i] != piece:
                piece, stack = c["piece"][i], []
            key = c["key"][i]
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if c["kind"][i] == 0:
                # Of equal prefixes the first, with the least rule_id, stays on top.
                if not (stack and stack[-1][0] == key):
                    stack.append((key, c["rule_id"][i], c["action"][i]))
            else:
                keep.append(i)
                ids.append(stack[-1][1] if stack else None)
                actions.append(stack[-1][2] if stack else None)
        if keep:
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(keep)), batch.column("url").take(pa.array(keep)), pa.array(ids, pa.int64()), pa.array(actions, pa.string())], ["page_id", "url", "rule_id", "action"])


def filter_urls(pages: DataFrame, rules: DataFrame, default_action: str = DEFAULT_ACTION) -> DataFrame:
    """page_id, url, rule_id and action of every page."""
    spark = pages.sparkSession
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumn("key", url_key(F.col("url")))
    path = shared_path(spark, "url-keys")
    keyed.write.parquet(path)
    keyed = spark.read.schema(keyed.schema).parquet(path)
    good = keyed.filter("key is not null")
    pieces = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Boundaries at the quantiles of a bounded number of keys; a frequent key may be several of them.
    fraction = min(1.0, pieces * SAMPLED / max(1, keyed.count()))
    sample = sorted(r[0] for r in good.sample(fraction, seed=7).select("key").limit(2 * pieces * SAMPLED).collect())
    bounds = [sample[len(sample) * i // pieces] for i in range(1, pieces)] if sample else []

    @F.pandas_udf("int")
    def piece(keys: pd.Series) -> pd.Series:
        out = []
        for n, k in enumerate(keys):
            lo, hi = bisect_left(bounds, k), bisect_right(bounds, k)
            out.append(hi if hi - lo < 2 else lo + 1 + n % (hi - lo))
        return pd.Series(out, dtype="int32")

    @F.pandas_udf("array<int>")
    def met(keys: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(bounds, k), bisect_right(bounds, k + _LAST) + 1)) for k in keys])

    urls = good.withColumn("piece", piece("key"))
    prefixes = rules.select(F.col("rule_id").cast("long").alias("rule_id"), rule_prefix(F.col("pattern").cast("string")).alias("key"), F.col("action").cast("string").alias("action")).filter("key is not null")
    # A rule goes to every piece that its interval meets.
    spread = prefixes.withColumn("piece", F.explode(met("key")))
    none = F.lit(None)
    both = urls.select("piece", "key", F.lit(1).alias("kind"), none.cast("long").alias("rule_id"), none.cast("string").alias("action"), "page_id", "url").unionByName(spread.select("piece", "key", F.lit(0).alias("kind"), "rule_id", "action", none.cast("long").alias("page_id"), none.cast("string").alias("url")))
    swept = both.repartition(pieces, "piece").sortWithinPartitions("piece", "key", "kind", "rule_id").mapInArrow(_sweep, "page_id long, url string, rule_id long, action string")
    bad = keyed.filter("key is null").select("page_id", "url", none.cast("long").alias("rule_id"), F.lit("invalid").alias("action"))
    return swept.withColumn("action", F.coalesce("action", F.lit(default_action))).unionByName(bad)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "rule_id long, pattern string, action string"))


_VALUES = ", ".join(f"({i}, '{p}', '{a}')" for i, p, a in RULES)
ORACLE = f"""
WITH r AS (
  SELECT rule_id, action,
         array_to_string(list_reverse(string_split(lower(split_part(pattern, '/', 1)), '.')), ',') || ',' ||
         CASE WHEN contains(pattern, '/') THEN ')' || substr(pattern, strpos(pattern, '/')) ELSE '' END AS prefix
  FROM (VALUES {_VALUES}) AS v(rule_id, pattern, action)),
u AS (
  SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM pages),
h AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*'), '^.*@', ''), '(:[0-9]*)?[.]*$', '') AS host,
         regexp_extract(rest, '^[^/?]*(.*)$', 1) AS path FROM u),
k AS (
  SELECT row_number() OVER () AS n, page_id, url,
         CASE WHEN host <> '' AND regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://')
              THEN array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ',)' ||
                   CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END END AS key
  FROM h),
m AS (
  SELECT n, page_id, url, key, rule_id, action, row_number() OVER (PARTITION BY n ORDER BY length(prefix) DESC NULLS LAST, rule_id) AS best
  FROM k LEFT JOIN r ON starts_with(key, prefix))
SELECT page_id, url, rule_id::BIGINT AS rule_id,
       CASE WHEN key IS NULL THEN 'invalid' ELSE coalesce(action, '{DEFAULT_ACTION}') END AS action
FROM m WHERE best = 1
"""
