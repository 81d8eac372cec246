"""URL filters with a path-template tree.

Rules (host, path start) decide first, the longest that fits; of rules of one length the first in alphabetical order. For all
other urls, and learning from those that rules have decided, a tree of path templates is grown per host, level by level: a
node whose children are many and rarely repeat is a variable segment and becomes a wildcard (*); of its other children those
whose share of blocked urls is not significantly different from the node's (a chi-square test with one degree of freedom)
are merged into one branch (~); the rest stay literal (=segment). A template is rejected if its smoothed purity, the share of
blocked urls among those that rules have decided, reaches a threshold. The prior that it is smoothed to is the purity of
the url's template in a tree of all hosts, so that a host without evidence of its own is judged by paths of the same
shape elsewhere; that one is smoothed to a half. Built-in expressions only.

Levels are grown as long as any node still branches, whatever the depth; urls that share all that is left of their path end
in one branch a segment, without a round of their own. Per-node tables are counts, summed before they are shuffled; they
are joined by broadcast only while they have at most `broadcast_nodes` rows, else by shuffle.

Cases: a null url, or one without ://, has empty host and path; a very long path is read to its end, and costs a round a
level down to where the last urls part; rows of equal url share verdicts, each counting as evidence; an empty table gives
an empty result; further columns pass through, but for those of a result's name, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import LOWER, UPPER, materialise, unique_name, without

#: A node is variable from so many children on, if they have fewer urls than so many each.
CHILDREN, REPEATS = 8, 4
#: Chi-square from which a branch differs (5 % with one degree of freedom).
CHI_SQUARE = 3.84
#: Purity is (blocked + SMOOTH * prior) / (decided + SMOOTH); from LEAST on a template is rejected.
SMOOTH, LEAST = 4.0, 0.8
BROADCAST_NODES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, start = rule.split("/", 1)
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, rules[rule]).otherwise(verdict)
    return name, verdict


def _side(df: DataFrame, broadcast_nodes: int) -> DataFrame:
    df = materialise(df, "nodes")
    return F.broadcast(df) if df.count() <= broadcast_nodes else df


def _grown(rows: DataFrame, group: str, template: str, parts: str, label: str, broadcast_nodes: int) -> DataFrame:
    """rows with the template of each path in the tree of its group (the columns' names are given)."""
    seg, wild_group, wild_template, own_group, own_template, own_seg = (unique_name(rows, x) for x in ("seg", "wild_group", "wild_template", "own_group", "own_template", "own_seg"))
    blocked = F.when(F.col(label) == "block", 1).otherwise(0)
    rows, level = rows.withColumn(template, F.lit("")), 0
    while True:
        now = rows.withColumn(seg, F.when(F.size(parts) > level, F.get(parts, F.lit(level))))
        rest = F.xxhash64(F.slice(parts, F.lit(level + 2), F.size(parts)))
        children = now.where(F.col(seg).isNotNull()).groupBy(F.col(group).alias("g"), F.col(template).alias("t"), F.col(seg).alias("seg"))
        children = children.agg(F.count(F.lit(1)).alias("n"), F.sum(blocked).alias("b"), F.min(rest).alias("lo"), F.max(rest).alias("hi"))
        children = materialise(children, "children")
        nodes = children.groupBy("g", "t").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.count(F.lit(1)).alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        if nodes.where("k > 1 OR lo <> hi").isEmpty():  # no node branches any more
            return rows.withColumn(template, F.concat(template, F.repeat(F.lit("/~"), F.greatest(F.lit(0), F.size(parts) - level))))
        variable = (F.col("k") >= CHILDREN) & (F.col("all_n") < F.col("k") * REPEATS)
        p = F.col("all_b") / F.col("all_n")
        off = F.col("b") - F.col("n") * p
        differs = (p > 0) & (p < 1) & (off * off >= F.lit(CHI_SQUARE) * (F.col("n") * p * (1 - p)))
        wild = nodes.where(variable).select(F.col("g").alias(wild_group), F.col("t").alias(wild_template))
        # A child is looked up in the table of its level's nodes, which has far fewer rows than there are urls of a hot host.
        own = children.drop("lo", "hi").join(nodes.where(~variable), ["g", "t"]).where(differs)
        own = own.select(F.col("g").alias(own_group), F.col("t").alias(own_template), F.col("seg").alias(own_seg))
        wild, own = _side(wild, broadcast_nodes), _side(own, broadcast_nodes)
        now = now.join(wild, (F.col(group) == F.col(wild_group)) & (F.col(template) == F.col(wild_template)), "left")
        now = now.join(own, (F.col(group) == F.col(own_group)) & (F.col(template) == F.col(own_template)) & (F.col(seg) == F.col(own_seg)), "left")
        branch = F.when(F.col(wild_group).isNotNull(), "/*").when(F.col(own_group).isNotNull(), F.concat(F.lit("/="), F.col(seg))).otherwise("/~")
        now = now.withColumn(template, F.when(F.col(seg).isNull(), F.col(template)).otherwise(F.concat(template, branch)))
        rows = materialise(now.drop(seg, wild_group, wild_template, own_group, own_template, own_seg), "urls")
        level += 1


def judged(df: DataFrame, rules: dict[str, str], url: str = "url", broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """df with host, path, rule (null if none fits), template, purity and verdict (allow or block)."""
    made = ("host", "path", "rule", "template", "purity", "verdict")
    df = without(df, made, url)
    label, parts, every, common, prior = (unique_name(df, x) for x in ("url_label", "url_parts", "url_every", "url_common", "url_prior"))
    leaf_group, leaf_template, n_blocked, n_decided = (unique_name(df, x) for x in ("leaf_group", "leaf_template", "n_blocked", "n_decided"))
    host, path = host_and_path(F.col(url))
    rows = df.withColumn("host", host).withColumn("path", path)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    inner = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(path, 2)"), "/", -1))
    rows = rows.withColumn("rule", name).withColumn(label, verdict).withColumn(parts, inner).withColumn(every, F.lit(""))
    rows = _grown(materialise(rows, "urls"), "host", "template", parts, label, broadcast_nodes)
    rows = _grown(rows, every, common, parts, label, broadcast_nodes)
    for group, template in ((every, common), ("host", "template")):
        counts = rows.groupBy(F.col(group).alias(leaf_group), F.col(template).alias(leaf_template))
        counts = counts.agg(F.sum(F.when(F.col(label) == "block", 1).otherwise(0)).alias(n_blocked), F.count(label).alias(n_decided))
        rows = rows.join(_side(counts, broadcast_nodes), (F.col(group) == F.col(leaf_group)) & (F.col(template) == F.col(leaf_template)), "left")
        before, after = (F.lit(0.5), prior) if group == every else (F.col(prior), "purity")
        rows = rows.withColumn(after, (F.col(n_blocked) + F.lit(SMOOTH) * before) / (F.col(n_decided) + F.lit(SMOOTH))).drop(leaf_group, leaf_template, n_blocked, n_decided)
    verdict = F.coalesce(F.col(label), F.when(F.col("purity") >= LEAST, "block").otherwise("allow"))
    return rows.withColumn("verdict", verdict).drop(label, parts, every, common, prior)
