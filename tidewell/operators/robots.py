"""SC16: robots rules. Files are read into rules for an agent, and requests are judged by the longest rule that fits.

A file is groups of rules, each behind one or more user-agent lines. An agent is
told by its name alone, in either case and without a version; all groups that name it
count, else those of `*`. In a pattern `*` stands for any run of characters and a `$`
at its end for the end of the path; the query belongs to the path. The longest
pattern that fits decides, allow before disallow where two are as long; no rule, no
file or a URL without a host allow. Of several numeric delays the last counts.
Comments, unknown lines, rules before any agent and empty patterns say nothing;
patterns are compared as they are written, percent signs included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIELDS = ("user-agent", "allow", "disallow", "crawl-delay")


def origin_of(url: Column) -> Column:
    """Scheme, host and port, lower-cased: what one robots file is about."""
    return F.lower(F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY"))))


def _target(url: Column) -> Column:
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.concat(path, F.coalesce(F.concat(F.lit("?"), F.try_parse_url(url, F.lit("QUERY"))), F.lit("")))


def rules_for(files: DataFrame, agent: str) -> DataFrame:
    """(origin, rules, delay) for each file of files(origin, text) that has lines of these kinds. One shuffle, by origin."""
    line = F.regexp_replace("line", "#.*", "")
    field = F.lower(F.trim(F.substring_index(line, ":", 1)))
    value = F.trim(F.regexp_replace(F.regexp_replace(line, r"^[^:]*:", ""), r"[\t\r]", " "))
    lines = files.select(F.lower("origin").alias("origin"), F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("pos", "line"))
    told = lines.where(F.contains("line", F.lit(":"))).select("origin", "pos", field.alias("field"), value.alias("value")).where(F.col("field").isin(*_FIELDS))
    ordered = Window.partitionBy("origin").orderBy("pos")
    starts = (F.col("field") == "user-agent") & ~F.lag("field", 1, "").over(ordered).eqNullSafe(F.lit("user-agent"))
    numbered = told.withColumn("starts", starts.cast("int")).withColumn("group", F.sum("starts").over(ordered))
    name = F.trim(F.substring_index(F.lower("value"), "/", 1))
    rule = F.struct(F.length("value").alias("size"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    delay = F.struct("pos", F.expr("try_cast(value AS double)").alias("delay"))
    groups = numbered.groupBy("origin", "group").agg(
        F.bool_or((F.col("field") == "user-agent") & (name == agent.lower())).alias("own"),
        F.bool_or((F.col("field") == "user-agent") & (name == "*")).alias("all"),
        F.collect_list(F.when(F.col("field").isin("allow", "disallow") & (F.col("value") != ""), rule)).alias("rules"),
        F.max(F.when((F.col("field") == "crawl-delay") & F.expr("try_cast(value AS double) IS NOT NULL"), delay)).alias("delay"),
    )
    kinds = {kind: [F.collect_list(F.when(F.col(kind), F.col("rules"))).alias(f"{kind}_rules"), F.max(F.when(F.col(kind), F.col("delay"))).alias(f"{kind}_delay")] for kind in ("own", "all")}
    files_ = groups.groupBy("origin").agg(F.bool_or("own").alias("named"), *kinds["own"], *kinds["all"])
    rules = F.when(F.col("named"), F.col("own_rules")).otherwise(F.col("all_rules"))
    delays = F.when(F.col("named"), F.col("own_delay")).otherwise(F.col("all_delay"))
    return files_.select("origin", F.array_distinct(F.flatten(rules)).alias("rules"), delays["delay"].alias("delay"))


def _fits(target: Column, pattern: Column) -> Column:
    literal = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(literal, r"\*+", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))
    return F.when(F.contains(pattern, F.lit("*")) | pattern.endswith("$"), F.regexp_like(target, regex)).otherwise(F.startswith(target, pattern))


def judged(requests: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Requests with allowed and delay_ms, given rules_for(...). A hot origin's requests are split by the skew join: its rules are one row."""
    known = rules.select(F.col("origin").alias("__origin"), F.col("rules").alias("__rules"), F.col("delay").alias("__delay"))
    joined = requests.join(known, origin_of(F.col(url)) == F.col("__origin"), "left").withColumn("__target", _target(F.col(url)))
    fitting = F.filter("__rules", lambda r: _fits(F.col("__target"), r["pattern"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["size"], r["allow"])))
    return joined.withColumns({"allowed": F.coalesce(best["allow"], F.lit(True)), "delay_ms": F.coalesce((F.col("__delay") * 1000).cast("long"), F.lit(0).cast("long"))}).drop("__origin", "__rules", "__delay", "__target")
