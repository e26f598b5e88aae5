"""Groups of similar things from candidate keys, without all pairs of a group.

Things that share a key are candidates; ``verify`` says which candidate pairs are linked.  Only the
connected groups are wanted, so a pair within one group already found need not be looked at.  First
each thing is held against one leader, and large groups of copies fall together; then ``rest`` names
the pairs between groups that may still be linked.  It must miss no linked pair of two things that share
a key, and is free to leave out what cannot be linked.

All steps are aggregations and equi-joins.  Leaders, counts and majorities are partial
aggregates; the joins back to the rows of a hot key are plain sort-merge joins, which adaptive
execution splits.  Every step ends in a written table, so a lost executor costs one step at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deklara.llm.common import materialise, remove


#: Nodes of a small key.
FEW = 32


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): one node of each component names it.

    Every node hooks to its smallest neighbour if that is smaller; the hooks are a forest, whose roots
    pointer jumping finds; the edges are drawn anew between roots.  Copies hang on one leader, so one
    turn is the rule; long chains take a logarithmic number.
    """
    spark = edges.sparkSession
    left, path = materialise(_canonical(edges), "edges")
    members = None
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        roots, roots_path = materialise(hooks, "roots")
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = roots.join(up, "root").select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved"))
            after, after_path = materialise(jumped, "roots")
            remove(spark, roots_path)
            roots, roots_path = after.select("node", "root"), after_path
            if after.where("moved").isEmpty():
                break
        ends = roots.select(F.col("node").alias("a"), F.col("root").alias("x"))
        other = roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
        rest = left.join(ends, "a").join(other, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        now, now_path = materialise(_canonical(rest), "edges")
        if members is None:
            members = roots.withColumnRenamed("root", "component")
        else:
            moved = roots.select(F.col("node").alias("component"), "root")
            members = members.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        members, _ = materialise(members, "members")
        remove(spark, path, roots_path)
        left, path = now, now_path
    if members is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    remove(spark, path)
    return members


def _canonical(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    )


@dataclass
class Rule:
    """What links two nodes.

    ``verify`` takes pairs (a, b) with a < b and returns those that are linked.  ``rest`` takes the rows
    (key, node, component, main) of keys that hold more than one group, ``main`` for the key's largest, and
    returns pairs (a, b) of nodes in two groups.  With ``turns`` the rows also have ``large``, for keys of more than ``FEW`` nodes, and
    ``rest`` is asked twice, with False for the pairs that share a small key, and with True for those that share large ones
    alone; between, at most a few pairs of each node are tried so often.
    """

    verify: Callable[[DataFrame], DataFrame]
    rest: Callable[..., DataFrame]
    turns: int = 0


def groups(keys: DataFrame, rule_for: Callable[[DataFrame], Rule]) -> DataFrame:
    """(node, component) of all nodes linked to another one; ``keys`` has (node, key).

    ``rule_for`` is called once with all nodes that share a key with another one, so that it can
    fetch what it needs of them, and gives the rule.

    First each node is held against one other: of the nodes that share a key with it, the one that meets
    most others, which in a group of copies is among the least changed.  What is linked so is merged.
    Then the rule's remaining pairs follow, all of them.  With turns the pairs of small keys come first, which are no more than
    ``FEW`` for each row, and in large keys each node outside of the largest group is held against a few others that chance
    picks.  What is linked so is merged before the large keys' pairs are made, for members of one group need not meet.
    What is left there are nodes of different groups: these pairs grow with the square of their number in a key.
    """
    spark = keys.sparkSession
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared, shared_path = materialise(keys.join(counts, "key"), "shared-keys")
    met, met_path = materialise(shared.groupBy("node").agg(F.sum("n").alias("met")), "met")
    rule = rule_for(met.select("node"))
    ranked = shared.select("key", "node").join(met, "node")
    leaders, leaders_path = materialise(ranked.groupBy("key").agg(F.max(F.struct("met", "node")).alias("leader")), "leaders")
    nearest = shared.select("key", "node").join(leaders, "key").groupBy("node").agg(F.max("leader").alias("leader"))
    proposed = nearest.select(F.col("node").alias("a"), F.col("leader.node").alias("b"))
    links, links_path = materialise(rule.verify(_canonical(proposed)), "links")
    members = connected(links)
    paths = [shared_path, met_path, leaders_path, links_path]

    def left(rows: DataFrame) -> DataFrame:
        found, path = materialise(_undecided(rows, members), "undecided")
        paths.append(path)
        return found

    def linked(pairs: DataFrame) -> DataFrame:
        found, path = materialise(rule.verify(_canonical(pairs)), "links")
        paths.append(path)
        return found

    rows = left(shared.withColumn("large", F.col("n") > FEW) if rule.turns else shared)
    if rule.turns:
        for turn in range(rule.turns + 1):
            if rows.isEmpty():
                break
            found = linked(_picked(rows, turn) if turn else rule.rest(rows, False))
            if not found.isEmpty():
                members = _merged(members, found)
                rows = left(rows)
    if not rows.isEmpty():
        members = _merged(members, linked(rule.rest(rows, True) if rule.turns else rule.rest(rows)))
    remove(spark, *paths)
    return members


def _picked(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) to try: each node outside of the largest group of a large key, with up to two nodes
    of that group and two others.  Chance picks one of either sort for each key, and of a node's keys the two."""
    chance = F.struct(F.xxhash64(F.lit(turn), "node").alias("chance"), "node", "component")
    rows = rows.where("large")
    picks = rows.groupBy("key").agg(F.max(F.when(F.col("main"), chance)).alias("inside"), F.max(F.when(~F.col("main"), chance)).alias("outside"))
    met = rows.where("not main").select("key", "node", "component").join(picks, "key")
    sides = []
    for side in ("inside", "outside"):
        other = F.when(F.col(f"{side}.component") != F.col("component"), F.col(side))
        sides += [F.max(other).alias(f"{side}_max"), F.min(other).alias(f"{side}_min")]
    tried = met.groupBy("node").agg(*sides)
    tried = tried.select("node", F.explode(F.array(*(F.col(f"{side}_{end}.node") for side in ("inside", "outside") for end in ("max", "min")))).alias("other"))
    return _canonical(tried.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))


def _merged(members: DataFrame, found: DataFrame) -> DataFrame:
    """The groups after ``found`` has linked some: only these groups are put together anew."""
    if found.isEmpty():
        return members
    own = {c: members.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")}
    drawn = found.select("a", "b").join(own["a"], "a", "left").join(own["b"], "b", "left")
    ends = connected(drawn.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    moved = ends.select(F.col("node").alias("component"), F.col("component").alias("end"))
    fresh = ends.join(members.select("node"), "node", "left_anti")
    before = members.join(moved, "component", "left").select("node", F.coalesce("end", "component").alias("component"))
    after, _ = materialise(before.unionByName(fresh.select("node", "component")), "members")
    return after


def _undecided(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows (key, node) of keys that hold more than one group, each with its group and whether
    that is the key's largest (``main``)."""
    more = [c for c in rows.columns if c == "large"]
    own = (
        rows.select("key", "node", *more)
        .join(members, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    sizes = own.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = (
        sizes.groupBy("key")
        .agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("groups"))
        .where("groups > 1")
        .select("key", F.col("top.component").alias("largest"))
    )
    return own.join(main, "key").select("key", "node", *more, "component", (F.col("component") == F.col("largest")).alias("main"))
