"""Operator 2: URL filter rules by a sort-merge range join.

A host is written with its labels reversed and a dot after each
(``www.example.net`` becomes ``net.example.www.``), so all hosts below a rule's
host share a prefix, an interval of the sorted keys, and such intervals nest.
Rules and urls are sorted together by key; sweeping over them, the last rule
opened before a url carries the stack of the rules around it, and those of the
stack that still contain the url's key are the active ones. Among them the
longest rule whose path starts the url's path decides.

Skew: urls are dealt by salt, not by host, and every salt sorts all rules with
its urls (rules times ``salts`` rows, and salts grow with the shuffle partitions
only, so the bound is rules times partitions); a host with a third of all urls is spread
evenly and the sweep streams, it holds no group. Everything is built-in
expressions and one window function.

Defined results: a null url or one without ``://`` has an empty host and path,
no rule and the default verdict; null or empty rule hosts never match, a null rule path
is empty; repeated urls give repeated results; of rules with the same host and
path the block rule comes first; empty tables work; other columns of the pages
are kept as they are (names starting ``__url_`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    """Labels reversed, a dot after each; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """The rules as literals of the plan."""
    rows = [F.struct(*(F.lit(v).cast("string").alias(c) for c, v in zip(("host", "path", "verdict"), rule))) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``key, stack``: one row per host of the rules, with the rules of that host and of all hosts above it, longest first."""
    own = rules.filter("host <> ''").select(
        host_key(F.translate("host", UPPER, LOWER)).alias("key"),
        F.struct(
            (-F.length(F.concat("host", F.coalesce("path", F.lit(""))))).alias("order"),
            F.when(F.col("verdict") == "block", 0).otherwise(1).alias("side"),
            F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        ).alias("r"),
    )
    own = own.withColumn("r", F.struct("r.*", F.col("key").alias("key")))
    hosts = own.select("key").distinct().withColumn("up", F.split("key", r"\.")).withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size("up") - 1), lambda n: F.concat(F.array_join(F.slice("up", 1, n), "."), F.lit(".")))))
    above = own.withColumnRenamed("key", "up")
    return hosts.join(above, "up").groupBy("key").agg(F.sort_array(F.collect_set("r")).alias("stack"))


def apply_url_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict (which replace columns of those names)."""
    spark = pages.sparkSession
    salts = salts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    row = F.struct(*[F.col(f"`{c}`") for c in names], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    probes = pages.select(row.alias("__url_row"), F.pmod(F.xxhash64(url, F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("__url_salt"))
    stacks = rule_stacks(rules)
    probes = probes.select("__url_salt", host_key(F.col("__url_row.host")).alias("__url_key"), F.lit(1).alias("__url_kind"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("__url_stack"), "__url_row")
    opens = stacks.select(
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__url_salt"), F.col("key").alias("__url_key"), F.lit(0).alias("__url_kind"), F.col("stack").alias("__url_stack"), F.lit(None).cast(probes.schema["__url_row"].dataType).alias("__url_row")
    )
    sweep = Window.partitionBy("__url_salt").orderBy("__url_key", "__url_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = probes.unionByName(opens).withColumn("__url_stack", F.last("__url_stack", ignorenulls=True).over(sweep)).filter("__url_kind = 1")
    fits = F.filter("__url_stack", lambda r: F.startswith(F.col("__url_key"), r["key"]) & F.startswith(F.col("__url_row.path"), r["path"]))
    best = F.get(fits, F.lit(0))
    return swept.select("__url_row.*", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
