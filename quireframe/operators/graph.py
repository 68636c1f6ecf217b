"""Graphs and hierarchies: reachability, inheritance along trees, dependency order. Trees take as many joins as the logarithm of their
depth; other graphs one a level, and what was seen is kept apart, so that a cycle ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireframe.session import checkpointed


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (node, depth) that edges (src, dst) lead to from ``roots`` (node), these included; depth counts the edges of
    a shortest way. Every level is checkpointed, and joined with none that came before. Joins are by sorting, so that no level
    goes through the driver."""
    edges = checkpointed(edges.select("src", "dst").distinct())
    level = checkpointed(roots.select("node", F.lit(0).alias("depth")).distinct())
    seen = [level]
    while level.limit(1).count():
        ahead = edges.join(level.select(F.col("node").alias("src"), "depth").hint("merge"), "src").select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        known = reduce(DataFrame.unionByName, seen).select("node")
        level = checkpointed(ahead.join(known.hint("merge"), "node", "left_anti"))
        seen.append(level)
        if len(seen) > 16:
            seen = [checkpointed(reduce(DataFrame.unionByName, seen))]
    return reduce(DataFrame.unionByName, seen)


def reachability(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every node of ``nodes`` and whether ``roots`` lead to it. Edges to nodes that are not there lead nowhere."""
    found = reached(edges.join(nodes.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_semi"), roots).select("node", F.lit(True).alias("_r"))
    return nodes.join(found.hint("merge"), "node", "left").select("node", F.coalesce("_r", F.lit(False)).alias("reachable"))


def inherited(nodes: DataFrame, columns: list[str], total: str | None = None) -> DataFrame:
    """Nodes (node, parent, ``columns``) of trees with each column's value taken from the nearest ancestor that has one, the
    node itself first; and depth, root and leaf. A node without a parent is a root; nodes that no root leads to (as on a
    cycle) are left out.

    With ``total``, a column of declared numbers of leaves, ``declared`` tells whether a node that is no leaf has so many.
    """
    own = checkpointed(nodes.select("node", "parent", *columns, *([total] if total else [])))
    parents = own.select(F.col("parent").alias("node")).filter("node IS NOT NULL").distinct().withColumn("_inner", F.lit(True))
    top = F.col("parent").isNull()
    state = own.join(parents, "node", "left").withColumns({"leaf": F.col("_inner").isNull(), "at": F.col("parent"), "depth": F.when(top, 0).otherwise(1), "root": F.when(top, F.col("node"))}).drop("_inner")
    state = checkpointed(state.withColumn("leaves", F.col("leaf").cast("long")))
    # A node knows what it meets on its first so many edges upwards, and the node there; each round joins it with what that one
    # knows and so doubles the edges. Those that meet no root in a round in which none met one meet none at all.
    edges, before = 1, None
    while (open_ := state.filter("root IS NULL AND at IS NOT NULL").count()) not in (0, before):
        before = open_
        above = state.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("root").alias("_root"), *[F.col(c).alias(f"_{c}") for c in columns])
        below = state.filter("at IS NOT NULL").groupBy(F.col("at").alias("node")).agg(F.sum("leaves").alias("_leaves"))
        kept = [c for c in state.columns if c not in ("at", "depth", "root", "leaves", *columns)]
        joined = state.join(above, "at", "left").join(below, "node", "left")
        state = checkpointed(joined.select(*kept, *[F.coalesce(c, f"_{c}").alias(c) for c in columns], F.col("_at").alias("at"), F.when(F.col("at").isNull(), F.col("depth")).otherwise(F.lit(edges) + F.col("_depth")).alias("depth"), F.coalesce("root", "_root").alias("root"), (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves")))
        edges *= 2
    out = state.filter("root IS NOT NULL").select("node", "parent", *columns, F.col("depth").cast("int").alias("depth"), "root", *([total] if total else []), "leaf", "leaves")
    if not total:
        return out.drop("leaves")
    return out.withColumn("declared", F.col("leaf") | F.col(total).eqNullSafe(F.col("leaves"))).drop(total)


def dependency_order(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """Each node of ``nodes`` (node) with level and status. Level is 0 for nodes that need nothing and otherwise one more
    than the largest level of what is needed (``needs``: node, needed), so that in order of level all comes after what it
    needs. Status is resolved; missing where something needed, at any remove, is no node; or cycle where a node needs
    itself, at any remove, or what does. A missing node comes before a cycle. Level is null unless resolved."""
    known = checkpointed(nodes.select("node").distinct())
    needs = needs.select("node", "needed").distinct().join(known, "node", "left_semi")
    absent = needs.join(known.select(F.col("node").alias("needed")), "needed", "left_anti").select("node")
    back = checkpointed(needs.select(F.col("needed").alias("src"), F.col("node").alias("dst")))
    lacking = checkpointed(reached(back, absent.distinct()).select("node"))
    open_ = checkpointed(known.join(lacking, "node", "left_anti"))
    waits = checkpointed(needs.join(open_, "node", "left_semi"))
    done, level = [], 0
    while True:
        ready = checkpointed(open_.join(waits.select("node").distinct(), "node", "left_anti"))
        if not ready.limit(1).count():
            break
        done.append(ready.select("node", F.lit(level).alias("level")))
        open_ = checkpointed(open_.join(ready, "node", "left_anti"))
        waits = checkpointed(waits.join(ready.select(F.col("node").alias("needed")), "needed", "left_anti").join(open_, "node", "left_semi"))
        level += 1
    none = F.lit(None).cast("int")
    out = [lacking.select("node", none.alias("level"), F.lit("missing").alias("status")), open_.select("node", none.alias("level"), F.lit("cycle").alias("status"))]
    return reduce(DataFrame.unionByName, [d.withColumn("status", F.lit("resolved")) for d in done] + out)


def parent_role(rows: DataFrame, tree: DataFrame, of: str, order: str, role: str) -> DataFrame:
    """``tree`` (``of``, ``order``, parent) with the role of each row and of its parent."""
    roles = rows.select(F.col(of).alias("_of"), F.col(order).alias("_at"), F.col(role).alias("parent_role"))
    return tree.join(roles, (F.col(of) == F.col("_of")) & (F.col("parent") == F.col("_at")), "left").drop("_of", "_at")


def missing_parents(rows: DataFrame, parts: list[str], level: str, fixed: int = 0, order: str | None = None) -> DataFrame:
    """Rows of a hierarchy of composite keys that lack their parent or repeat their key: all columns and code, repeated or
    orphan. With ``order``, late is one whose parent is there, but not before it (a parent that repeats counts by its first). After the first ``fixed`` parts, a row of level n is named by n parts, the others being 0, and its parent by one
    part less."""
    keys = [F.col(p).alias(f"_{p}") if i < fixed else F.when(F.col(level) - 1 > i - fixed, F.col(p)).otherwise(0).alias(f"_{p}") for i, p in enumerate(parts)]
    own = rows.dropna(subset=parts)
    parents = own.groupBy(*[F.col(p).alias(f"_{p}") for p in parts]).agg(F.lit(True).alias("_here"), *([F.min(order).alias("_first")] if order else []))
    counted = own.select("*", *keys, F.count("*").over(Window.partitionBy(*parts)).alias("_n"))
    # A few small columns look small enough to send to the driver, and are not once they are unpacked: both sides are sorted.
    each = counted.join(parents.hint("merge"), [f"_{p}" for p in parts], "left")
    code = F.when(F.col("_n") > 1, "repeated").when((F.col(level) > 1) & F.col("_here").isNull(), "orphan")
    if order:
        code = code.when((F.col(level) > 1) & (F.col("_first") >= F.col(order)), "late")
    return each.withColumn("code", code).filter("code IS NOT NULL").drop("_n", "_here", "_first", *[f"_{p}" for p in parts])


def depth_faults(rows: DataFrame, of: str, order: str, depth: str, step: int = 2) -> DataFrame:
    """Rows of depth-coded trees whose depth is no step from that of the row before: not a multiple of ``step``, negative,
    not 0 at the beginning, or deeper by more than one step. A depth that is none counts as 0 for the row after."""
    ok = F.coalesce((F.col(depth) >= 0) & (F.col(depth) % step == 0), F.lit(False))
    w = Window.partitionBy(of).orderBy(order)
    plain = F.when(ok, F.col(depth)).otherwise(0)
    before = F.lag(plain).over(w)
    fault = ~ok | F.when(before.isNull(), F.col(depth) != 0).otherwise((F.col(depth) > before) & (F.col(depth) != before + step))
    return rows.withColumn("_fault", fault).filter("_fault").drop("_fault")
