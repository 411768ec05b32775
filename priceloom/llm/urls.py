"""Path-template tree for judging urls, in DataFrame functions only.

Per host, paths become templates: digits are generalised by shape, a level with many
rare children turns them into a wildcard, and children whose labelled rate cannot
be told from that of their siblings are merged. A template is rejected when
the smoothed share of bad labels below it is high. Given rules go before the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.functions.scale import settle
from priceloom.llm.common import ascii_lower, table

#: (host, path, verdict); the longest fitting rule wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Levels of the tree with one segment each; the segments below are one child more, written out.
LEVELS = 8
# A level with at least this many children turns those below RARE of its urls into "*".
MANY_CHILDREN = 16
RARE = 0.02
# Children within this many standard errors of their siblings' rate are merged.
SIMILAR = 1.96
# Weight of the parent's rate in a smoothed rate; rate from which a template is rejected.
PRIOR = 4.0
REJECT = 0.75
_JOINT = "/"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``; path: then up to ``?``, ``#``. Both empty without ``://``."""
    at = F.instr(F.col(url), "://")
    after = F.when(at > 0, F.col(url).substr(at + 3, F.length(F.col(url)))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    rest = after.substr(F.length(host) + 1, F.length(after) + 1)
    return ascii_lower(host), F.regexp_extract(rest, "^[^?#]*", 0)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host followed by path) and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def shape(path: Column, levels: int = LEVELS) -> Column:
    """The path with every run of digits written as ``#``, cut into ``levels`` segments and the rest of the path as one more."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "#"), _JOINT)
    return F.when(F.size(parts) > levels, F.concat(F.slice(parts, 1, levels), F.array(F.array_join(F.slice(parts, levels + 1, F.size(parts)), _JOINT)))).otherwise(parts)


def template_tree(urls: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Templates of ``urls`` (host, shape, bad: true, false or null if unlabelled).

    Returns host, shape, template, purity: one row per distinct shape of a host. Urls are
    counted per shape first; all later work is on that table, one level at a time.
    """
    table_ = settle(
        urls.groupBy("host", "shape").agg(
            F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.count(F.when(F.col("bad"), 1)).alias("bad")
        ).withColumn("prefix", F.lit("")),
        "url-shapes",
    )
    deepest = table_.agg(F.coalesce(F.max(F.size("shape")), F.lit(0))).first()[0]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    for level in range(deepest):
        child = F.when(F.size("shape") > level, F.element_at("shape", F.when(F.size("shape") > level, level + 1).otherwise(1)))
        rows = table_.withColumn("child", child)
        children = rows.where(F.col("child").isNotNull()).groupBy("host", "prefix", "child").agg(*sums)
        siblings = children.groupBy(F.col("host").alias("_h"), F.col("prefix").alias("_p")).agg(
            F.count(F.lit(1)).alias("_k"), *[F.sum(c).alias(f"_{c}") for c in ("n", "labelled", "bad")]
        )
        rate = (F.col("_bad") + 1) / (F.col("_labelled") + 2)
        error = F.sqrt(rate * (1 - rate) / F.col("labelled"))
        rare = (F.col("_k") >= MANY_CHILDREN) & (F.col("n") < RARE * F.col("_n"))
        alike = (F.col("labelled") == 0) | (F.abs(F.col("bad") / F.nullif(F.col("labelled"), F.lit(0)) - rate) < SIMILAR * error)
        merged = children.join(siblings, (F.col("host") == F.col("_h")) & (F.col("prefix") == F.col("_p"))).where(
            (F.col("_k") > 1) & (rare | alike)
        ).select(F.col("host").alias("_h"), F.col("prefix").alias("_p"), F.col("child").alias("_c"))
        same = (F.col("host") == F.col("_h")) & (F.col("prefix") == F.col("_p")) & (F.col("child") == F.col("_c"))
        step = F.when(F.col("child").isNull(), F.lit("")).when(F.col("_c").isNotNull(), F.lit("/*")).otherwise(F.concat(F.lit("/"), "child"))
        table_ = settle(
            rows.join(merged, same, "left").withColumn("prefix", F.concat("prefix", step)).drop("_h", "_p", "_c", "child"), "url-level"
        )
    everything = table_.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2))).first()[0]
    smooth = lambda bad, labelled, parent: (bad + PRIOR * parent) / (labelled + PRIOR)
    hosts = table_.groupBy(F.col("host").alias("_h")).agg(
        smooth(F.sum("bad"), F.sum("labelled"), F.lit(float(everything))).alias("_host_rate")
    )
    templates = (
        table_.groupBy("host", F.col("prefix").alias("template")).agg(*sums)
        .join(hosts, F.col("host") == F.col("_h"))
        .select(F.col("host").alias("_h"), F.col("template"), smooth(F.col("bad"), F.col("labelled"), F.col("_host_rate")).alias("purity"))
    )
    return table_.join(templates, (F.col("host") == F.col("_h")) & (F.col("prefix") == F.col("template"))).select(
        "host", "shape", "template", "purity"
    )


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """Verdict on every url: page_id, host, path, rule, verdict, template, purity.

    Without ``labels`` (page_id, bad; one row per page) the urls that a rule decides
    are the labelled ones, so templates near blocked ones are blocked too. Null urls
    and urls without ``://`` have an empty host and path and form a template of their own;
    repeated rows are judged alike and all kept; other columns are not read; an empty table gives
    an empty result.
    """
    host, path = host_and_path()
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "said": said})
    shaped = parsed.withColumn("shape", shape(F.col("path")))
    if labels is None:
        known = shaped.withColumn("bad", F.col("said") == "block")
    else:
        known = shaped.join(labels.select(F.col("page_id").alias("_id"), F.col("bad").cast("boolean").alias("bad")),
                            F.col("page_id") == F.col("_id"), "left")
    known = settle(known.select("page_id", "host", "path", "rule", "said", "shape", "bad"), "urls")
    tree = settle(template_tree(known).select(F.col("host").alias("_h"), F.col("shape").alias("_s"), "template", "purity"), "url-tree")
    by_tree = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return known.join(tree, (F.col("host") == F.col("_h")) & (F.col("shape") == F.col("_s")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", by_tree).alias("verdict"), "template", "purity"
    )


def op8_path_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, then by the tree."""
    return judge(table(spark, sf_dir, "pages"))
