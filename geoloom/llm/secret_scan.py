"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. A ledger in
the shared folder holds which (blob, rule, rule version) have been scanned, and the
findings. Findings of new blobs alone are recorded, and only of rules they have not
met; they are then joined back to all paths. Texts always stay where they are. While
the new blobs are few, their places are broadcast after their number is checked, and
each is scanned once, at one of its places. In a large increment every place is
scanned with all rules, and what is found there meets the new blobs: copies and blobs
that were scanned before are then scanned again, without effect on what is recorded.

Defined results
  * Null text has no blob and no finding. Empty text is a blob without findings.
  * Texts of any length are scanned whole; extra columns of any name don't matter;
    an empty table has no findings. A null doc_id or path stays null.
  * A finding is (blob, rule, secret): ``n`` counts the secret's occurrences in the
    blob. The secret is given as its SHA-256, never itself.
  * Repeated rows, and copies under other paths, each get the findings of the blob.
  * A rule's new version is scanned over all blobs; findings of its former versions
    stay in the ledger, and only the present version is joined back.
  * An increment that failed half-way is repeated: its folder counts once it has
    been recorded whole, findings before the scanned pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import read, shared_path, written


@dataclass(frozen=True)
class Rule:
    """``keyword`` is text that every match contains; it spares the regular expression most blobs."""

    rule_id: str
    version: int
    pattern: str
    keyword: str

    @property
    def key(self) -> str:
        return f"{self.rule_id}@{self.version}"


RULES = (
    Rule("aws-access-key", 2, "AKIA[0-9A-Z]{16}", "AKIA"),
    Rule("password-assignment", 1, "password=[0-9a-f]{8,}", "password="),
    Rule("github-token", 1, "gh[pousr]_[0-9A-Za-z]{36}", "_"),
    Rule("private-key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY"),
    Rule("slack-token", 1, "xox[baprs]-[0-9A-Za-z-]{10,}", "xox"),
    Rule("api-key-assignment", 1, "api_key *[=:] *\"?[0-9A-Za-z_-]{16,}", "api_key"),
    Rule("quoted-hex-secret", 1, "\"[0-9a-f]{32,64}\"", "\""),
    Rule("json-web-token", 1, "eyJ[0-9A-Za-z_-]{8,}[.]eyJ[0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]*", "eyJ"),
)

#: New blobs whose places are broadcast (about 300 bytes each); beyond, every place is scanned.
FEW = 100_000

_FINDINGS = "blob string, rule_id string, rule_version int, secret string, n long"
_SCANNED = "blob string, rules array<string>"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the increments before have written; nothing if there is none."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def addressed(versions: DataFrame) -> DataFrame:
    """doc_id, path and blob of every version. The text stays where it is."""
    return versions.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.sha2(F.col("text").cast("string"), 256).alias("blob"))


def scan_increment(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what ``versions`` (doc_id, path, text) has and the ledger has not; gives the addressed places."""
    spark = versions.sparkSession
    every = F.array(*[F.lit(r.key) for r in rules])
    seen = _table(spark, f"{ledger}/scanned", _SCANNED).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("met"))
    places = written(addressed(versions), "secrets-places")
    blobs = places.filter("blob is not null").groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    todo = written(blobs.join(seen, "blob", "left").select("blob", "doc_id", F.array_except(every, F.coalesce("met", F.array().cast("array<string>"))).alias("todo")).filter(F.size("todo") > 0), "secrets-todo")
    few = todo.limit(FEW + 1).count() <= FEW
    each = _scanned(versions, todo, rules, few)
    name = shared_path(spark, "increment").rpartition("/")[2]
    each.select("blob", F.explode("hits").alias("x")).groupBy("blob", "x.rule_id", "x.rule_version", "x.secret").agg(F.count("*").alias("n")).write.parquet(f"{ledger}/findings/{name}")
    todo.select("blob", F.col("todo").alias("rules")).write.parquet(f"{ledger}/scanned/{name}")
    return places


def _scanned(versions: DataFrame, todo: DataFrame, rules: tuple[Rule, ...], few: bool) -> DataFrame:
    """blob and hits of the blobs of ``todo`` that have any, by the rules they still have to meet; no text is shuffled."""
    hits = F.concat(*[_hits(r) for r in rules])
    texts = versions.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"))
    if few:
        # One place of each new blob.
        place = todo.select(F.col("doc_id").alias("_doc"), "blob", "todo")
        found = F.broadcast(place).join(texts, place["_doc"].eqNullSafe(texts["_doc"])).filter(F.sha2("text", 256) == F.col("blob"))
        # Rows that repeat a doc_id and its text repeat the matches as well; one of them counts.
        return found.select("blob", hits.alias("hits")).filter(F.size("hits") > 0).dropDuplicates(["blob"])
    every = F.array(*[F.lit(r.key) for r in rules])
    found = texts.withColumn("todo", every).select("text", hits.alias("hits")).filter(F.size("hits") > 0).select(F.sha2("text", 256).alias("blob"), "hits").dropDuplicates(["blob"])
    unmet = F.filter("hits", lambda x: F.array_contains("todo", F.concat(x["rule_id"], F.lit("@"), x["rule_version"].cast("string"))))
    return found.join(todo.select("blob", "todo"), "blob").select("blob", unmet.alias("hits")).filter(F.size("hits") > 0)


def _hits(rule: Rule) -> Column:
    """The matches of one rule, if the blob still has to meet it."""
    none = F.array().cast("array<struct<rule_id:string,rule_version:int,secret:string>>")
    matches = F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)), lambda s: F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.version).alias("rule_version"), F.sha2(s, 256).alias("secret")))
    return F.when(F.array_contains("todo", rule.key) & F.contains("text", F.lit(rule.keyword)), matches).otherwise(none)


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, places: DataFrame | None = None) -> DataFrame:
    """The findings of the rules' present versions at every path of ``versions``; ``places`` are these, if they have been addressed."""
    spark = versions.sparkSession
    # An increment that was begun again may have left its findings twice.
    now = _table(spark, f"{ledger}/findings", _FINDINGS).filter(F.concat("rule_id", F.lit("@"), "rule_version").isin([r.key for r in rules])).dropDuplicates(["blob", "rule_id", "rule_version", "secret"])
    return (addressed(versions) if places is None else places).join(now, "blob").select("doc_id", "path", "blob", "rule_id", "rule_version", "secret", "n")


def versions_of(docs: DataFrame) -> DataFrame:
    """Documents as versions of files."""
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions, ledger = versions_of(read(spark, sf_dir, "documents")), shared_path(spark, "secrets-ledger")
    return findings(versions, ledger, places=scan_increment(versions, ledger))


_UNION = " UNION ALL ".join(f"SELECT doc_id, path, blob, '{r.rule_id}' AS rule_id, {r.version}::INT AS rule_version, unnest(regexp_extract_all(text, '{r.pattern}')) AS s FROM v" for r in RULES)
ORACLE = f"""
WITH v AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, sha256(text) AS blob, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, path, blob, rule_id, rule_version, sha256(s) AS secret, count(*)::BIGINT AS n FROM ({_UNION}) GROUP BY ALL
"""
