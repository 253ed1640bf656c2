"""URL rules by a sort-merge range join over reversed-host keys; DataFrame functions only.

A host becomes its labels in reverse order, each closed by a slash: ``www.example.com`` is ``com/example/www/``.  All
subdomains of a rule's host then share its key as a prefix, so a rule host is an interval of keys, and intervals nest
or are disjoint.  Interval starts and ends and the urls are sorted together; each boundary carries the stack of rule
hosts that are open behind it, and a url takes the stack of the last boundary at or before its key.  Among the stack's
rules whose path starts the url's path the longest wins.

The sweep runs side by side in groups (top label, salt): a top label with many urls is salted in proportion to its
share, and its rules are repeated for each salt, so no group holds more than about rows / shuffle partitions.

Defined results: a null url, or one without ``://``, has empty host and path and meets no rule; a rule with a null host
or path is ignored; equal rules count once, and of rules of equal length the longer host, then ``block``, wins; the
default verdict holds where no rule fits; with no rules all urls get it; repeated rows are judged alike and each kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: More labels than this in a rule's host is refused; urls may have any number.
MAX_LABELS = 127


def _lower(c: Column) -> Column:
    """A-Z only, as the hosts of urls are compared byte by byte."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased; empty without ``://``."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.concat_ws("/", F.reverse(F.split(host, r"\."))), F.lit("/"))


def _top(key: Column) -> Column:
    return F.substring_index(key, "/", 1)


def boundaries(rules: DataFrame) -> DataFrame:
    """(top, key, stack) for each start and end of a rule host's interval: the rules open from this key on, longest first."""
    own = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(_lower(F.col("host")).alias("host"), "path", "verdict").distinct()
    own = own.withColumn("key", host_key(F.col("host"))).withColumn("rule", F.concat("host", "path"))
    own = own.withColumn("key", F.when(F.size(F.split("key", "/")) <= MAX_LABELS + 1, F.col("key")).otherwise(F.raise_error(F.lit("a rule's host has too many labels"))))
    by_host = own.groupBy("key").agg(F.collect_list(F.struct("path", "rule", "verdict", F.length("rule").alias("n"), F.length("host").alias("h"))).alias("rules"))
    # Each host's own prefixes are the only keys whose intervals can hold it.
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), "/")
    ups = by_host.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "/"), F.lit("/")))).alias("up"))
    open_at = ups.join(by_host.select(F.col("key").alias("up"), "rules"), "up").groupBy("key").agg(F.collect_list(F.struct(F.length("up").alias("depth"), "up", "rules")).alias("open"))

    def stack(opened: Column) -> Column:
        flat = F.flatten(F.transform(opened, lambda o: o["rules"]))
        ranked = F.array_sort(F.transform(flat, lambda r: F.struct((-r["n"]).alias("a"), (-r["h"]).alias("b"), F.when(r["verdict"] == "block", 0).otherwise(1).alias("c"), r["rule"].alias("rule"), r["path"].alias("path"), r["verdict"].alias("verdict"))))
        return F.transform(ranked, lambda r: F.struct(r["rule"].alias("rule"), r["path"].alias("path"), r["verdict"].alias("verdict")))

    starts = open_at.select(_top(F.col("key")).alias("top"), F.col("key"), F.lit(1).alias("kind"), F.length("key").alias("depth"), stack(F.col("open")).alias("stack"))
    # '0' follows '/' in byte order: the end is the first key behind all that start with the host's key.  Of ends that
    # fall together the outermost holds, and a start at the same key comes after them.
    above = open_at.withColumn("above", F.filter(F.col("open"), lambda o: o["depth"] < F.length("key")))
    ends = above.select(_top(F.col("key")).alias("top"), F.expr("concat(substring(key, 1, length(key) - 1), '0')").alias("key"), F.lit(0).alias("kind"), (-F.length("key")).alias("depth"), stack(F.col("above")).alias("stack"))
    return starts.unionByName(ends)


def judge(urls: DataFrame, rules: DataFrame, *, keep: list[str], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``keep`` columns with host, path, rule (host + path, or null) and verdict for every row."""
    spark = urls.sparkSession
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    rows = urls.select(kept, host_of(F.col(url_col).cast("string")).alias("host"), path_of(F.col(url_col).cast("string")).alias("path")).withColumn("key", host_key(F.col("host"))).withColumn("top", _top(F.col("key")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = boundaries(rules)
    # Only top labels that have rules are swept, and only those need salts.
    tops = marks.select("top").distinct()
    volume = rows.groupBy("top").count().join(tops, "top")
    salts = volume.select("top", F.ceil(F.col("count") * (4 * parts) / F.lit(max(1, urls.count()))).cast("int").alias("salts"))
    spread = rows.join(salts, "top", "left")
    spread = spread.withColumn("salt", F.when(F.col("salts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("kept", "key", "path"), F.col("salts")).cast("int")))
    events = marks.join(salts, "top").select("top", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "kind", "depth", "stack")
    swept = spread.where("salt >= 0").select("top", "salt", "key", F.lit(2).alias("kind"), F.lit(0).alias("depth"), "kept", "host", "path")
    order = Window.partitionBy("top", "salt").orderBy("key", "kind", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = swept.unionByName(events, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("kind = 2")
    won = F.filter(F.coalesce(F.col("stack"), F.array().cast(marks.schema["stack"].dataType)), lambda r: F.startswith(F.col("path"), r["path"]))
    judged = both.withColumn("won", F.try_element_at(won, F.lit(1))).select("kept", "host", "path", F.col("won.rule").alias("rule"), F.coalesce(F.col("won.verdict"), F.lit(default)).alias("verdict"))
    rest = spread.where("salt < 0").select("kept", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionByName(rest).select("kept.*", "host", "path", "rule", "verdict")
