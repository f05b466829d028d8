"""URL rules by hashed expressions: host suffixes times path stems, joined on short hash prefixes, then confirmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _stem(path: Column) -> Column:
    """A path up to its last slash; the rest of a rule's path is compared as text."""
    return F.regexp_extract(path, r"^((?s:.*)/|)", 1)


def _expression(host: Column, stem: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), stem), 256)


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) per row of `pages`, for `rules` (host, path, verdict).

    A rule fits its host and all subdomains where the url's path starts with the rule's path. Of the rules that fit, the
    longest (host and path together) wins; of equally long ones a block, then the lesser. `rule` is its host and path; without
    a rule it is null and the verdict is `default`.

    * Each url gives one expression per host suffix and path stem (up to a slash), but none longer than the longest rule's labels and
      slashes, which the rules' own maxima state. Expressions meet rules on the first 32 bits of SHA-256; then the full digest and the
      rest of the rule's path must agree.
    * Null urls and urls without :// have an empty host and path. Repeated rows each get a row, null ids too. Rules with a null
      part or no host are left out; repeated rules count once. Empty tables are fine, and other columns are not read.
    * Spark broadcasts the rules if they are small; otherwise the join shuffles expressions and splits skewed prefixes. Only matched
      expressions go on, and are reduced before their one shuffle with the urls.
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null and host <> ''").distinct()
    most = rules.agg(F.max(F.size(F.split("host", r"\.", -1))), F.max(F.size(F.split("path", "/", -1)))).first()
    labels, slashes = most[0] or 0, most[1] or 1
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    nothing = F.lit(None).cast("struct<size:int,stop:int,rule:string,verdict:string>")
    base = rows.select("id", "url", F.lit(1).cast("long").alias("rows"), nothing.alias("best"))
    if labels:
        rule = F.concat("host", "path")
        best = F.struct((-F.length(rule)).alias("size"), (-(F.col("verdict") == "block").cast("int")).alias("stop"), rule.alias("rule"), F.col("verdict").alias("verdict"))
        keyed = rules.select(_expression(F.col("host"), _stem(F.col("path"))).alias("full"), F.col("path").alias("rule_path"), best.alias("best"))
        keyed = keyed.withColumn("prefix", F.substring("full", 1, PREFIX_HEX))
        parts = rows.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        names = F.split("host", r"\.", -1)
        depth = F.least(F.size(names), F.lit(labels))
        suffixes = F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(names, -k, k), "."))
        pieces = F.split(_stem(F.col("path")), "/", -1)
        levels = F.least(F.size(pieces), F.lit(slashes))
        stems = F.transform(F.sequence(F.lit(1), levels), lambda k: F.when(k == 1, F.lit("")).otherwise(F.concat(F.array_join(F.slice(pieces, F.lit(1), k - 1), "/"), F.lit("/"))))
        stated = parts.where("host <> ''").select("id", "url", "path", F.explode(suffixes).alias("suffix"), stems.alias("stems")).select("id", "url", "path", "suffix", F.explode("stems").alias("stem"))
        hashed = stated.select("id", "url", "path", _expression(F.col("suffix"), F.col("stem")).alias("own")).withColumn("prefix", F.substring("own", 1, PREFIX_HEX))
        hits = hashed.join(keyed, "prefix").where((F.col("own") == F.col("full")) & F.startswith("path", "rule_path"))
        base = base.union(hits.select("id", "url", F.lit(0).cast("long").alias("rows"), "best"))
    # (-size, -stop, rule) in rising order puts the winner first, so one min per url is enough.
    out = base.groupBy("id", "url").agg(F.sum("rows").alias("rows"), F.min("best").alias("best"))
    out = out.select("id", "url", "best", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return out.select(F.col("id").alias(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
