r"""URL filtering by a tree of path templates, under a short list of rules.

A URL's path is cut into segments.  Numbers, hexadecimal names, dates and the
like become wildcards at once; a branching point with many children, of which
few recur, has all of them replaced by one.  Sibling branches whose shares of
bad labels do not differ significantly from those of their siblings together
are merged.  Each template is judged by
the share of bad ones among its labelled URLs, smoothed towards its host's
share, which is smoothed towards a prior.  Rules of host and path prefix come first.

All of it is DataFrame functions over counts: URLs are pre-aggregated to
(host, typed path), so a host with a third of all URLs is one small tree.

Result of odd inputs: a null URL and one without ``://`` have empty host and
path, and are judged with the other URLs of the empty host; with no labels the
prior decides; null ids are kept; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, written

#: Levels of the tree; segments that lie deeper make up the last level's together.
LEVELS = 8
#: A branching point is generalised if it has more children than this, of
#: which each has fewer URLs than that on average.
CHILDREN, RECURS = 20, 8
#: Siblings merge whose share of bad labels lies within so many standard errors of their siblings'.
SAME_Z = 1.96
#: Segment that stands for the merged branches of a branching point.
ALIKE = "{alike}"
#: Labels that the prior share counts for, and the prior share of bad ones.
SMOOTHING, PRIOR = 8.0, 0.2
#: Templates with at least this smoothed share of bad ones are rejected.
REJECTED = 0.6
WILDCARD = "*"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host/path prefix

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    after = _after(url)
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def typed(path: Column) -> Column:
    """Segments of a path, with variable ones as wildcards that keep their suffix."""
    one = r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9a-fA-F-]{32,36})(\.[A-Za-z0-9]{1,5})?$"
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(one), F.concat(F.lit(WILDCARD), F.regexp_extract(s, one, 1))).otherwise(s))
    rest = F.array(F.array_join(F.slice(parts, LEVELS, F.greatest(F.size(parts) - LEVELS + 1, F.lit(1))), "/"))
    return F.when(F.size(parts) > LEVELS, F.concat(F.slice(parts, 1, LEVELS - 1), rest)).otherwise(parts)


def templates(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (host, path, bad, weight) with bad null where unlabelled: the
    mapping (host, typed, template), and (host, template, n, labelled, bad)."""
    w = F.coalesce(F.col("weight"), F.lit(1)).cast("long")
    total = lambda hit: F.sum(F.when(hit, w).otherwise(F.lit(0)))
    rows = urls.groupBy("host", typed(F.col("path")).alias("typed"))
    rows = rows.agg(F.count("*").alias("n"), total(F.col("bad").isNotNull()).alias("labelled"), total(F.col("bad")).alias("bad"))
    tree, _ = written(rows.withColumn("t", F.col("typed")), "tree")
    depth = tree.agg(F.max(F.size("t"))).first()[0] or 0
    for d in range(depth):
        tree, _ = written(_generalise(tree, d), "tree")
    for d in reversed(range(depth)):
        tree, _ = written(_merge(tree, d), "tree")
    path = F.concat(F.lit("/"), F.array_join("t", "/")).alias("template")
    mapping = tree.select("host", "typed", path)
    return mapping, tree.groupBy("host", path).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))


def _tail(d: int) -> Column:
    """The segments below level d."""
    return F.slice("t", d + 2, F.greatest(F.size("t") - d - 1, F.lit(0)))


def _generalise(tree: DataFrame, d: int) -> DataFrame:
    """Level d: replace all children of a point where hardly any recurs."""
    here = F.size("t") > d
    before = F.slice("t", 1, d).alias("before")
    child = F.element_at("t", d + 1).alias("child")
    kids = tree.where(here).select("host", before, child, "n").groupBy("host", "before", "child").agg(F.sum("n").alias("n"))
    many = kids.groupBy("host", "before").agg(F.count("*").alias("kids"), F.sum("n").alias("n"))
    many = many.where((F.col("kids") > CHILDREN) & (F.col("n") < RECURS * F.col("kids")))
    many = many.select("host", "before", F.lit(True).alias("many"))
    flagged = tree.withColumn("before", F.when(here, F.slice("t", 1, d))).join(many, ["host", "before"], "left")
    new = F.concat(F.slice("t", 1, d), F.array(F.lit(WILDCARD)), _tail(d))
    return flagged.select("host", "typed", "n", "labelled", "bad", F.when(F.col("many"), new).otherwise(F.col("t")).alias("t"))


def differs(k: Column, b: Column, k_all: Column, b_all: Column) -> Column:
    """Whether b bad of k labels differ significantly from the rest of b_all of
    k_all.  Without labels on either side nothing shows that they do."""
    k1, b1, k2, b2 = k + 1.0, b + 0.5, k_all - k + 1.0, b_all - b + 0.5
    share = (b1 + b2) / (k1 + k2)
    z = F.abs(b1 / k1 - b2 / k2) / F.sqrt(share * (1 - share) * (1 / k1 + 1 / k2))
    return (k > 0) & (k < k_all) & (z > SAME_Z)


def _merge(tree: DataFrame, d: int) -> DataFrame:
    """Level d: siblings (templates that differ in this segment only) become
    one, but for those whose share differs from that of the others together.

    Each is held against the whole of the others, so no chain of weakly
    labelled branches joins two that differ."""
    here = F.size("t") > d
    others = F.concat(F.slice("t", 1, d), F.array(F.lit("")), _tail(d))
    sibling = tree.where(here).groupBy("host", others.alias("others"), F.element_at("t", d + 1).alias("child"))
    sibling = sibling.agg(F.sum("labelled").alias("k"), F.sum("bad").alias("b"))
    point = sibling.groupBy("host", "others").agg(F.count("*").alias("kids"), F.sum("k").alias("ka"), F.sum("b").alias("ba"))
    same = (F.col("kids") > 1) & ~differs(F.col("k"), F.col("b"), F.col("ka"), F.col("ba"))
    named = sibling.join(point, ["host", "others"]).where(same).select("host", "others", "child", F.lit(ALIKE).alias("name"))
    marked = tree.withColumn("others", F.when(here, others)).withColumn("child", F.when(here, F.element_at("t", d + 1)))
    new = F.concat(F.slice("t", 1, d), F.array("name"), _tail(d))
    joined = marked.join(named, ["host", "others", "child"], "left")
    return joined.select("host", "typed", "n", "labelled", "bad", F.when(F.col("name").isNotNull(), new).otherwise(F.col("t")).alias("t"))


def judged(stats: DataFrame) -> DataFrame:
    """(host, template, purity): the smoothed share of good ones."""
    hosts = stats.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    p_host = (F.col("hb") + SMOOTHING * PRIOR) / (F.col("hl") + SMOOTHING)
    return stats.join(hosts, "host").select("host", "template", (1.0 - (F.col("bad") + SMOOTHING * p_host) / (F.col("labelled") + SMOOTHING)).alias("purity"))


def judge(urls: DataFrame, rules: tuple[Rule, ...], labels: Column, weight: Column | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every URL with page_id, host, path, rule, template, purity and verdict.

    ``labels`` is a column over host, path and the columns of ``urls`` that is
    true for bad URLs, false for good ones, and null for those without label;
    ``weight`` says for how many labels each counts (1)."""
    url = F.col(url_col)
    rows = urls.withColumns({"_host": host_of(url), "_path": path_of(url)})
    rows = rows.select(F.col(id_col).alias("page_id"), F.col("_host").alias("host"), F.col("_path").alias("path"), labels.alias("bad"), (F.lit(1) if weight is None else weight).alias("weight"))
    mapping, stats = templates(rows)
    fate = mapping.join(judged(stats), ["host", "template"])
    out = rows.withColumn("typed", typed(F.col("path"))).join(fate, ["host", "typed"], "left")
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(rule["verdict"], F.when(F.col("purity") <= 1.0 - REJECTED, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", rule["rule"].alias("rule"), "template", "purity", verdict.alias("verdict"))
