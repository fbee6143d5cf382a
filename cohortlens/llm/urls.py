"""URL filtering by mined association rules, with fixed host and path rules first.

DataFrame operations and ``pyspark.ml.fpm`` only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import stage

#: (action, host, path prefix); the longest fitting rule decides.
FIXED_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
               ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Share of labelled URLs that a combination must hold, and the confidence a rule needs.
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.9
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IS = "verdict="


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased A-Z) and path; both empty for null or a URL without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def fixed_rule(host: Column, path: Column, rules=FIXED_RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` and its action; null where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    name = action = F.lit(None).cast("string")
    for what, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(action)
    return name, action


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels counted from the end, path segments by place, query keys and
    fragment. Digits are generalised to ``0``, so page numbers make no tokens of their own."""
    shape = lambda c: F.regexp_replace(F.translate(c, _UPPER, _LOWER), "[0-9]+", "0")
    labels = F.reverse(F.filter(F.split(host, "[.]"), lambda x: x != ""))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return F.array_sort(F.array_distinct(F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)\A(.*?)://", 1)))),
        F.transform(labels, lambda x, i: F.concat(F.lit("label"), i.cast("string"), F.lit("="), shape(x))),
        F.transform(segments, lambda x, i: F.concat(F.lit("path"), F.least(i, F.lit(8)).cast("string"), F.lit("="), shape(x))),
        F.transform(F.filter(F.split(query, "[&;]"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), shape(F.substring_index(x, "=", 1)))),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")))))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               most_tokens: int = 3) -> DataFrame:
    """Rules (rule_id, tokens, verdict, confidence, support) from rows (tokens, verdict).

    Equal token sets of one verdict keep their multiplicity, so support is a share of labelled URLs.
    Rules with a token superfluous (a shorter rule of the same verdict is at least as confident)
    are pruned. A null verdict is not a label. Without labels there are no rules.
    """
    spark = labelled.sparkSession
    items = labelled.filter("verdict is not null").select(F.concat("tokens", F.array(F.concat(F.lit(_IS), "verdict"))).alias("items"))
    items = stage(items, "url-items")
    if items.isEmpty():
        return spark.createDataFrame([], "rule_id long, tokens array<string>, verdict string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = (model.associationRules.filter(F.col("consequent")[0].startswith(_IS) & (F.size("antecedent") <= most_tokens))
             .select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], F.lit(len(_IS) + 1), F.lit(100)).alias("verdict"),
                     "confidence", "support"))
    rules = stage(rules.withColumn("rule_id", F.xxhash64("tokens", "verdict")), "url-rules")
    # A rule is superfluous if dropping one or two of its tokens leaves a rule as confident.
    parts = rules.select("rule_id", "verdict", "confidence", "tokens", F.explode("tokens").alias("gone")).select(
        "rule_id", "verdict", "confidence", F.array_remove("tokens", F.col("gone")).alias("part"))
    singles = rules.filter(F.size("tokens") > 2).select("rule_id", "verdict", "confidence", F.explode("tokens").alias("one")).select(
        "rule_id", "verdict", "confidence", F.array("one").alias("part"))
    shorter = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("other"))
    useless = parts.union(singles).join(shorter, ["part", "verdict"]).filter("other >= confidence").select("rule_id").distinct()
    return rules.join(useless, "rule_id", "left_anti").select("rule_id", "tokens", "verdict", "confidence", "support")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Best rule of each row (set_id, tokens): (set_id, verdict, confidence), absent where none matches.

    The index lists each rule under its rarest token, so frequent tokens have short lists; what the
    index yields is checked on the whole rule. The most confident rule wins, then the better supported,
    then ``block``.
    """
    posted = token_sets.select("set_id", F.explode("tokens").alias("token"))
    spread = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    keyed = rules.select("*", F.explode("tokens").alias("token")).join(spread, "token")
    index = (keyed.groupBy("rule_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
             .join(rules, "rule_id").withColumnRenamed("tokens", "needed"))
    hits = (posted.join(index, "token").join(token_sets, "set_id")
            .filter(F.size(F.array_except("needed", "tokens")) == 0))
    best = hits.groupBy("set_id").agg(F.max(F.struct("confidence", "support", F.col("verdict").alias("verdict"))).alias("best"))
    return best.select("set_id", "best.verdict", "best.confidence")


def filter_urls(pages: DataFrame, rules=FIXED_RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Verdict of every page url: page_id, host, path, rule, verdict, confidence.

    URLs that a fixed rule decides are the labels; token combinations mined from them decide the others,
    and ``allow`` holds where no mined rule matches. URLs are first reduced to distinct token sets, so
    a host or URL that fills a third of the table is matched once. A null or malformed url has an empty
    host and path, no tokens, and gets ``allow``. Repeated and null page_ids are kept row by row;
    other columns are ignored; an empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    name, action = fixed_rule(F.col("host"), F.col("path"), rules)
    tokens = F.when(F.col("host") != "", url_tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    told = base.select("page_id", "host", "path", name.alias("rule"), action.alias("action"), tokens.alias("tokens"))
    told = stage(told.withColumn("set_id", F.xxhash64("tokens")), "urls")
    mined = stage(mine_rules(told.select("tokens", F.col("action").alias("verdict")), min_support, min_confidence), "mined")
    sets = stage(told.filter("action is null").groupBy("set_id").agg(F.min("tokens").alias("tokens")), "token-sets")
    best = match_rules(sets, mined)
    return told.join(best, "set_id", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", "verdict", F.lit(DEFAULT)).alias("verdict"), "confidence")
