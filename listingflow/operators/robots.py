"""URL x robots rules: most specific agent group, longest pattern, Allow wins ties."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import url_part

_PLAIN = r"\A[A-Za-z0-9/?&=:+,;@!$'()*~._-]*\z"


def robot_path(path: Column) -> Column:
    """Comparable form of a path: octets of unreserved characters decoded, others upper-case
    hex, anything outside the URL alphabet percent-encoded as UTF-8."""
    tokens = F.regexp_extract_all(path, F.lit(r"(?s)(%[0-9A-Fa-f]{2}|.)"), F.lit(1))

    def one(token):
        octet = F.char(F.conv(F.substring(token, 2, 2), 16, 10).cast("int"))
        return (F.when(token.rlike(r"\A%[0-9A-Fa-f]{2}\z"),
                       F.when(octet.rlike(r"\A[A-Za-z0-9._~-]\z"), octet).otherwise(F.upper(token)))
                .when(token.rlike(r"\A[A-Za-z0-9/%?&=:+,;@!$'()*~._-]\z"), token)
                .when(token == " ", F.lit("%20")).otherwise(F.url_encode(token)))

    return F.when(path.rlike(_PLAIN), path).otherwise(F.array_join(F.transform(tokens, one), ""))


def _pattern_regex(pattern: Column) -> Column:
    body = F.regexp_replace(pattern, r"\$\z", "")
    # Quote every literal stretch; a star stands for any run of characters.
    quoted = F.concat(F.lit(r"\Q"), F.array_join(F.split(body, r"\*"), r"\E.*\Q"), F.lit(r"\E"))
    return F.concat(F.lit(r"(?s)\A"), quoted, F.when(pattern.endswith("$"), F.lit(r"\z")).otherwise(""))


def effective_rules(rules: DataFrame, agent: str) -> DataFrame:
    """Rules that bind ``agent`` per site, as one array (groups of one agent are merged).

    A site's rules come from one file of bounded size, so the array is small; the number
    of sites may be large, and the join below is left to Spark's size check.
    """
    score = F.when(F.col("agent") == "*", 0).when(
        F.lit(agent.lower()).contains(F.lower("agent")), F.length("agent"))
    scored = rules.withColumn("score", score).filter("score IS NOT NULL")
    rule = F.when(F.col("pattern") != "", F.struct(
        F.length(F.regexp_replace(robot_path(F.col("pattern")), r"\*|\$\z", "")).alias("len"),
        F.col("allow").alias("allow"), robot_path(F.col("pattern")).alias("prefix"),
        # most rules are plain prefixes; only the others need a pattern compiled for them
        F.when(F.col("pattern").rlike(r"\*|\$\z"), _pattern_regex(robot_path(F.col("pattern")))).alias("regex")))
    best = scored.groupBy("site", "score").agg(F.collect_list(rule).alias("rules")).groupBy("site").agg(
        F.max_by("rules", "score").alias("rules"))
    return best


def can_fetch(pages: DataFrame, rules: DataFrame, agent: str, url: str = "url", site: str = "site") -> DataFrame:
    query = url_part(F.col(url), "query")
    path = F.concat(F.coalesce(F.nullif(url_part(F.col(url), "path"), F.lit("")), F.lit("/")),
                    F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    joined = pages.withColumn("_path", robot_path(path)).join(effective_rules(rules, agent), site, "left")
    meets = lambda r: F.when(r["regex"].isNull(), F.startswith(F.col("_path"), r["prefix"])).otherwise(F.regexp_like(F.col("_path"), r["regex"]))
    hits = F.transform(F.filter("rules", meets),
                       lambda r: F.struct(r["len"].alias("len"), r["allow"].alias("allow")))
    return joined.withColumn("allowed", F.coalesce(F.array_max(hits)["allow"], F.lit(True))).drop("_path", "rules")
