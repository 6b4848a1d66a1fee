"""Hierarchies and crawls as level-by-level joins. Each level is written out, so lineage stays short and executors can be lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import dates as D
from quillstone.scratch import materialise as _cut


def ancestors(nodes: DataFrame, start: DataFrame, node: str = "node_id", parent: str = "parent_id", most: int = 32) -> DataFrame:
    """(start, node, distance) for all ancestors of the start nodes (column `node`), themselves at 0. Cycles end; a chain of more than `most` is an error."""
    edges = nodes.select(F.col(node).alias("__n"), F.col(parent).alias("__p")).where("__p IS NOT NULL").distinct()
    frontier = start.select(F.col(node).alias("start"), F.col(node)).distinct().withColumn("distance", F.lit(0))
    seen = _cut(frontier)
    frontier = seen
    for level in range(1, most + 1):
        step = frontier.join(edges, F.col(node) == F.col("__n")).select("start", F.col("__p").alias(node)).distinct()
        frontier = _cut(step.join(seen.select("start", node), ["start", node], "left_anti").withColumn("distance", F.lit(level)))
        if not frontier.take(1):
            return seen
        seen = seen.unionByName(frontier)
    raise ValueError(f"some node has ancestors at a distance of {most} or more")


def ancestor_paths(nodes: DataFrame, start: DataFrame, node: str = "node_id", parent: str = "parent_id", label: str | None = None) -> DataFrame:
    """(start, path): labels from the root down to the start node. Of several rows of a node the smallest label counts."""
    label = label or node
    found = ancestors(nodes, start, node, parent)
    names = nodes.groupBy(node).agg(F.min(label).alias("__label"))
    return found.join(names, node, "left").groupBy("start").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.coalesce("__label", F.col(node)).alias("l")))), lambda s: s["l"]).alias("path"))


def preorder(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", order: str = "position", most: int = 64) -> DataFrame:
    """All nodes below the roots with depth and pre-order place, by a sort key made of the positions on the way down.

    A tree of more than `most` levels, or a cycle below a root, is an error.
    """
    base = nodes.select(F.col(node), F.col(parent), F.col(order).alias("__o"))
    level = base.where(F.col(parent).isNull()).select(node, F.array(F.struct("__o", F.col(node).alias("n"))).alias("__path"), F.lit(0).alias("depth"))
    out = level = _cut(level)
    for depth in range(1, most + 1):
        up = level.select(F.col(node).alias("__up"), "__path")
        step = base.join(up, F.col(parent) == F.col("__up")).select(node, F.concat("__path", F.array(F.struct("__o", F.col(node).alias("n")))).alias("__path"), F.lit(depth).alias("depth"))
        level = _cut(step)
        if not level.take(1):
            break
        out = out.unionByName(level)
    else:
        raise ValueError(f"the tree has {most} levels or more below its roots")
    return out.withColumn("place", F.row_number().over(Window.orderBy("__path"))).drop("__path")


def allowed(url: Column, patterns: list[str]) -> Column:
    """A prefix, or a regular expression after `regex:`, matches. No patterns: true."""
    out = F.lit(not patterns)
    for p in patterns:
        out = out | (url.rlike(p[6:]) if p.startswith("regex:") else F.startswith(url, F.lit(p)))
    return out


def is_document(url: Column) -> Column:
    """The path ends like a file that is not a page."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))).rlike(r"\.(pdf|docx?|xlsx?|zip)$")


def same_host(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(a, F.lit("HOST"))) == F.lower(F.try_parse_url(b, F.lit("HOST"))), F.lit(False))


def in_years(url: Column, first: int | None, last: int | None) -> Column:
    """The year that a path names is within the window; paths without a year pass."""
    y = D.year_from_path(url)
    return y.isNull() | (y.between(first if first is not None else 0, last if last is not None else 9999))


def crawl(links: DataFrame, seeds: DataFrame, depth: int, follow=None, most_pages: int | None = None, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first over links (source, target) from seeds (url). Returns (visited: url, depth; frontier that is left).

    `follow` is a predicate on columns url and target for links worth following. The two frames are the whole state: pass
    them back as `state` (visited and frontier in one frame, with a `done` flag) to go on where a run stopped.
    """
    if state is None:
        visited, frontier = None, seeds.select("url").distinct().withColumn("depth", F.lit(0))
    else:
        visited, frontier = _cut(state.where("done").select("url", "depth")), state.where("NOT done").select("url", "depth")
    frontier = _cut(frontier)
    pages = visited.count() if visited is not None else 0
    while frontier.take(1):
        if most_pages is not None:
            room = most_pages - pages
            if room <= 0:
                break
            taken = _cut(frontier.orderBy("depth", "url").limit(room))
            rest = frontier.join(taken.select("url"), "url", "left_anti")
        else:
            taken, rest = frontier, None
        visited = taken if visited is None else visited.unionByName(taken)
        pages += taken.count() if most_pages is not None else 0
        step = taken.where(F.col("depth") < depth).join(links.select(F.col("source").alias("url"), "target"), "url")
        if follow is not None:
            step = step.where(follow(F.col("url"), F.col("target")))
        step = step.groupBy(F.col("target").alias("url")).agg((F.min("depth") + 1).alias("depth"))
        if rest is not None:
            step = step.unionByName(rest).groupBy("url").agg(F.min("depth").alias("depth"))
        frontier = _cut(step.join(visited.select("url"), "url", "left_anti"))
    return visited if visited is not None else frontier.where(F.lit(False)), frontier


def crawl_state(visited: DataFrame, frontier: DataFrame) -> DataFrame:
    return visited.select("url", "depth").withColumn("done", F.lit(True)).unionByName(frontier.select("url", "depth").withColumn("done", F.lit(False)))


def change_action(known: Column, validator: Column, stored_validator: Column, content_hash: Column, stored_hash: Column) -> Column:
    """new; skip (same validator, body not read); touch (same hash) or changed."""
    clean = lambda v: F.regexp_replace(F.lower(F.coalesce(v, F.lit(""))), r'^w/|"|\s', "")
    same = (clean(validator) != "") & (clean(validator) == clean(stored_validator))
    return F.when(~known, "new").when(same, "skip").when(content_hash.eqNullSafe(stored_hash), "touch").otherwise("changed")


def safe_to_fetch(url: Column) -> Column:
    """https to a public host: no credentials, no local names, no private or link-local addresses."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    private = r"^(localhost|.*\.local|.*\.internal|0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|\[?::1|\[?f[cd]|\[?fe80)"
    return F.lower(url).rlike("^https://") & (host != "") & ~host.rlike(private) & F.try_parse_url(url, F.lit("USERINFO")).isNull()
