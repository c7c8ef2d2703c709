"""Operator 4: URL filters by a path-template tree for each host.

The path of a URL is a list of segments.  Numbers, hexadecimal ids and dates in a segment are
replaced by their type.  Then the tree of a host is built level by level.  If a node has
``MANY`` or more rare children (each with less than ``RARE`` of the node's URLs), these are
generalised to wildcards, but only with their like: a rare child is compared with all other
rare ones together, by the share of labelled URLs that are bad and by the share of URLs that
end at the child (two-proportion z-tests at ``STRICT``, as there are many).  Those that don't
differ become ``*``; those that do become wildcards of their own, told by how they differ:
``*{worse}``, ``*{better}``, ``*{leaf}`` (more URLs end there), ``*{inner}``, and both together.  So a bad
directory among many clean ones isn't lost in the wildcard.  At most 1 / RARE + MANY children
that aren't rare or few, and 9 wildcards, are left for a node, whatever the number of URLs; those that are statistically
alike (z-tests at ``ALIKE``) become one branch.

A template is rejected if its purity, the share of bad URLs among its labelled ones, is at
least ``PURITY``.  Purity is smoothed with ``STRENGTH`` pseudo-labels at the rate of the
template's host, itself smoothed with as many at the rate of the whole table; so a template
without labels is judged by its host, and a host without labels by the table.

Segments from the ``depth``-th on are treated as one, so a hostile URL can't deepen the tree; the
default of ``DEPTH`` is beyond the paths that sites have.  Query and fragment aren't part of a template.
All counts are made by aggregations and joins on (host, node, segment); nothing of a host is
gathered in one task but the children that are left for a node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

DEPTH = 8
MANY = 8
RARE = 0.1
ALIKE = 1.96
STRICT = 4.0
STRENGTH = 4.0
PURITY = 0.5

_HEAD = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"


def host_of(url: Column) -> Column:
    """The host in lower case, without a leading www; null if the URL has none."""
    host = F.lower(F.regexp_extract(url, _HEAD + r"(\[[^\]]*\]|[^/?#:\s]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def segments_of(url: Column, depth: int = DEPTH) -> Column:
    """The typed segments of the path; those beyond ``depth`` joined to the last."""
    path = F.regexp_extract(url, _HEAD + r"[^/?#]*([^?#\s]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    typed = F.transform(parts, typed_segment)
    tail = F.array_join(F.slice(typed, depth, F.greatest(F.size(typed), F.lit(1))), "/")
    return F.when(F.size(typed) > depth, F.concat(F.slice(typed, 1, depth - 1), F.array(tail))).otherwise(typed)


def typed_segment(segment: Column) -> Column:
    low = F.lower(segment)
    low = F.regexp_replace(low, r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{uuid}")
    low = F.regexp_replace(low, r"(?<![a-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{8,}(?![a-z0-9])", "{hex}")
    low = F.regexp_replace(low, r"(?<![0-9])(19|20)[0-9]{2}[-_.](0?[1-9]|1[0-2])[-_.](0?[1-9]|[12][0-9]|3[01])(?![0-9])", "{date}")
    return F.regexp_replace(low, r"[0-9]+", "{num}")


def differ(a: int, n: int, b: int, m: int) -> bool:
    """Whether the proportions a / n and b / m differ significantly; never where there is no case."""
    if not n or not m:
        return False
    p = (a + b) / (n + m)
    spread = math.sqrt(p * (1 - p) * (1 / n + 1 / m))
    return abs(a / n - b / m) > ALIKE * spread if spread else False


def _with_wildcards(counts: DataFrame) -> DataFrame:
    """Adds ``wildcard``: how a rare child differs from the other rare ones together."""
    of = lambda x, y: x / F.nullif(y, F.lit(0))
    for name, a, n in (("worse", "bad", "labelled"), ("leaf", "ends", "urls")):
        other, others = F.col(f"rare_{a}") - F.col(a), F.col(f"rare_{n}") - F.col(n)
        counts = counts.withColumns({f"{name}_share": of(F.col(f"rare_{a}"), F.col(f"rare_{n}")), f"{name}_off": of(F.col(a), F.col(n)) - of(other, others), f"{name}_case": of(F.lit(1), F.col(n)) + of(F.lit(1), others)})
        share, off = F.col(f"{name}_share"), F.col(f"{name}_off")
        spread = share * (1 - share) * F.col(f"{name}_case")
        counts = counts.withColumn(name, F.when((spread > 0) & (off * off > STRICT**2 * spread), F.signum(off)))
    kinds = F.concat_ws(",", F.when(F.col("worse") > 0, "worse").when(F.col("worse") < 0, "better"), F.when(F.col("leaf") > 0, "leaf").when(F.col("leaf") < 0, "inner"))
    return counts.withColumn("kinds", kinds).withColumn("wildcard", F.when(F.col("kinds") == "", "*").otherwise(F.concat(F.lit("*{"), "kinds", F.lit("}"))))


def merged_branches(children: list[tuple[str, int, int, int, int]]) -> dict[str, str]:
    """Child to branch name.

    children: (name, urls, urls that end here, labelled, bad).  In the order of bad share, share
    of ends and name, a child joins the last branch if it is like the whole of it, else it
    begins another.  A branch is named by its members.
    """
    order = sorted(children, key=lambda c: (c[4] / c[3] if c[3] else 0.0, c[2] / c[1], c[0]))
    groups: list[list] = []
    for name, urls, ends, labelled, bad in order:
        if groups and not differ(groups[-1][4], groups[-1][3], bad, labelled) and not differ(groups[-1][2], groups[-1][1], ends, urls):
            last = groups[-1]
            last[0].append(name)
            for k, x in enumerate((urls, ends, labelled, bad), 1):
                last[k] += x
        else:
            groups.append([[name], urls, ends, labelled, bad])
    return {name: "|".join(sorted(g[0])) for g in groups for name in g[0]}


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for host, prefix, children in zip(frame["host"], frame["prefix"], frame["children"], strict=True):
            listed = [(c["child"], c["urls"], c["ends"], c["labelled"], c["bad"]) for c in children]
            rows += [(host, prefix, child, branch) for child, branch in merged_branches(listed).items()]
        yield pd.DataFrame(rows, columns=["host", "prefix", "child", "branch"])


def url_templates(pages: DataFrame, labels: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, segments, template, urls, labelled, bad) for each different typed path of each host."""
    judged = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), segments_of(F.col("url"), depth).alias("segments")).where("host is not null")
    paths = (
        urls.join(judged, "page_id", "left")
        .groupBy("host", "segments")
        .agg(F.count(F.lit(1)).alias("urls"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("prefix", F.lit(""))
    )
    paths = cut(paths)
    deepest = paths.agg(F.coalesce(F.max(F.size("segments")), F.lit(0))).first()[0]
    node = ["host", "prefix"]
    for level in range(1, deepest + 1):
        here = paths.where(F.size("segments") >= level).withColumn("segment", F.element_at("segments", level))
        counts = cut(
            here.groupBy(*node, "segment").agg(
                F.sum("urls").alias("urls"), F.sum(F.when(F.size("segments") == level, F.col("urls")).otherwise(0)).alias("ends"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
            )
        )
        sizes = counts.groupBy(*node).agg(F.sum("urls").alias("node_urls"))
        sized = counts.join(sizes, node).withColumn("rare", F.col("urls") < RARE * F.col("node_urls"))
        pools = sized.where("rare").groupBy(*node).agg(F.count(F.lit(1)).alias("many"), *(F.sum(c).alias(f"rare_{c}") for c in ("urls", "ends", "labelled", "bad")))
        named = cut(
            _with_wildcards(sized.join(pools, node, "left"))
            .withColumn("child", F.when(F.col("rare") & (F.col("many") >= MANY), F.col("wildcard")).otherwise(F.col("segment")))
            .select(*node, "segment", "child", "urls", "ends", "labelled", "bad")
        )
        branches = (
            named.groupBy(*node, "child")
            .agg(*(F.sum(c).alias(c) for c in ("urls", "ends", "labelled", "bad")))
            .groupBy(*node)
            .agg(F.collect_list(F.struct("child", "urls", "ends", "labelled", "bad")).alias("children"))
            .mapInPandas(_merge, "host string, prefix string, child string, branch string")
        )
        named = named.select(*node, "segment", "child").join(branches, [*node, "child"]).select(*node, "segment", "branch")
        going = here.join(named, [*node, "segment"]).withColumn("prefix", F.concat("prefix", F.lit("/"), "branch")).drop("segment", "branch")
        paths = cut(going.unionByName(paths.where(F.size("segments") < level)))
    return paths.withColumn("template", F.when(F.col("prefix") == "", "/").otherwise(F.col("prefix"))).drop("prefix")


def url_filter(pages: DataFrame, labels: DataFrame, purity: float = PURITY, depth: int = DEPTH) -> DataFrame:
    """Each page with its template, the template's smoothed purity and whether it is rejected.

    labels: (page_id, bad 0/1); a page labelled more than once is bad if any label says so.
    Result: page_id, host, template, labelled, purity, rejected.

    A page whose url is null, empty or has no host isn't in a tree: host, template and purity are
    null and it isn't rejected.  A null page_id is a page without a label.  Repeated rows are
    repeated URLs.  Other columns of pages are ignored, whatever their names.  An empty table
    gives no rows; without any label the purity is 0 and nothing is rejected.
    """
    paths = url_templates(pages, labels, depth)
    templates = paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    total = templates.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0))).first()[0]
    hosts = templates.groupBy("host").agg(((F.sum("bad") + STRENGTH * total) / (F.sum("labelled") + STRENGTH)).alias("host_rate"))
    smooth = templates.join(hosts, "host").select(
        "host", "template", "labelled", F.round((F.col("bad") + STRENGTH * F.col("host_rate")) / (F.col("labelled") + STRENGTH), 6).alias("purity")
    )
    where = paths.select("host", "segments", "template").join(smooth, ["host", "template"])
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), segments_of(F.col("url"), depth).alias("segments"))
    return found.join(where, ["host", "segments"], "left").select("page_id", "host", "template", "labelled", "purity", F.coalesce(F.col("purity") >= purity, F.lit(False)).alias("rejected"))
