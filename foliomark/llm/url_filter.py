"""URL filters: host-suffix and path-prefix expressions against a table of rules.

Each URL is expanded into the expressions (suffix of its host, directory of its path), each rule is filed
under the one expression that it can be found by, and both meet in an equi-join on a short prefix of the
expressions' digests.  The full digest and the rest of the rule's path are then compared, and of the rules
that fit the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, lower_ascii, named

#: Hex digits of a digest that rows are joined on.
PREFIX = 8
#: Rules with their digests are broadcast up to this size, measured; above it the join is salted.
BROADCAST_BYTES = 32_000_000
SALTS = 32

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What stands between ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _digest(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), directory), 256)


def _suffixes(host: Column, most: int) -> Column:
    labels = F.split(host, r"\.", -1)
    count = F.size(labels)
    return F.transform(
        F.sequence(F.lit(1), F.least(count, F.lit(most))),
        lambda k: F.array_join(F.slice(labels, count - k + 1, k), "."),
    )


def _directories(path: Column, most: int) -> Column:
    """The path's beginnings that end in a slash, and the empty one, up to ``most`` slashes."""
    pieces = F.split(path, "/", -1)
    return F.transform(
        F.sequence(F.lit(0), F.least(F.size(pieces) - 1, F.lit(most))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(pieces, 1, k), "/"), F.lit("/"))),
    )


def _filed(rules: DataFrame) -> DataFrame:
    host = lower_ascii(F.col("host"))
    path = F.coalesce(F.col("path"), F.lit(""))
    directory = F.regexp_extract(path, "(?s)^(.*/)", 1)
    return (
        rules.where(F.col("host").isNotNull() & F.col("verdict").isin("allow", "block"))
        .select(
            host.alias("rule_host"), path.alias("rule_path"), "verdict", directory.alias("rule_directory"),
            _digest(host, directory).alias("rule_digest"),
        )
        .withColumn("short", F.substring("rule_digest", 1, PREFIX))
        .groupBy("short", "rule_digest", "rule_host", "rule_path", "rule_directory")
        .agg(F.max("verdict").alias("rule_verdict"))
    )


def filter_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with the columns host, path, rule and verdict.

    ``rules`` has host, path and verdict (``allow`` or ``block``).  A rule fits its host and all hosts below
    it if the URL's path starts with the rule's path.  The longest rule (host and path together) decides;
    among equally long ones the one with the longer host, then the one later in code-point order.  The same
    rule given with both verdicts blocks.  Without a fitting rule, ``rule`` is null and the verdict is
    ``default``.

    A null URL, or one without ``://``, has an empty host and path.  Rules without host or with another
    verdict are ignored; a null path counts as empty.  Empty tables give what follows from this.  Every
    input row comes out once, repeated rows too.  Input columns named like the new ones are replaced.
    """
    host, path, size = fresh(urls, "url_host_", "url_path_", "n_")
    rows = urls.withColumns({host: url_host(named(url)), path: url_path(named(url))})
    filed = checkpointed(_filed(rules))
    most = filed.agg(
        F.max(F.size(F.split("rule_host", r"\.", -1))).alias("labels"),
        F.max(F.length("rule_directory") - F.length(F.translate("rule_directory", "/", ""))).alias("slashes"),
        F.sum(200 + F.octet_length("rule_host") + 2 * F.octet_length("rule_path")).alias("bytes"),
    ).first()

    # expressions deeper than the deepest rule can meet none
    expressions = (
        rows.groupBy(F.col(host).alias("h"), F.col(path).alias("p"))
        .agg(F.count(F.lit(1)).alias(size))
        .select("h", "p", F.explode(_suffixes(F.col("h"), most["labels"] or 1)).alias("suffix"))
        .select("h", "p", "suffix", F.explode(_directories(F.col("p"), most["slashes"] or 0)).alias("directory"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("directory")))
        .withColumn("short", F.substring("digest", 1, PREFIX))
    )
    if (most["bytes"] or 0) <= BROADCAST_BYTES:
        met = expressions.join(F.broadcast(filed), "short")
    else:  # a third of all URLs may share an expression
        salted = filed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expressions.withColumn("salt", F.pmod(F.xxhash64("h", "p"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("length"),
        F.length("rule_host").alias("host_length"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    best = (
        met.where((F.col("digest") == F.col("rule_digest")) & F.col("p").startswith(F.col("rule_path")))
        .groupBy("h", "p")
        .agg(F.max(rank).alias("best"))
    )
    new = {"host", "path", "rule", "verdict"}
    kept = [rows[f"`{c}`"] for c in urls.columns if c.lower() not in new]
    return rows.join(best, (rows[host] == best["h"]) & (rows[path] == best["p"]), "left").select(
        *kept,
        rows[host].alias("host"),
        rows[path].alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
