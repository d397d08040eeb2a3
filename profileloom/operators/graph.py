"""Foreign-key graphs, hierarchies and object dependencies as iterated joins."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cut(df: DataFrame, *counts: Column) -> DataFrame | tuple[DataFrame, dict[str, int]]:
    """With counts, named aggregates, also their values, from the same job. Writes df as a table to the shared folder the cluster names and goes on from there; where it names none, to a folder of our own, but only on a local master.

    A table has sizes of its own. Those of a checkpoint are estimated from what it came from, and estimates of iterated joins grow without bound.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        named = sc.getCheckpointDir()
    path = f"{named}/table-{uuid.uuid4().hex}"
    seen = Observation()
    (df.observe(seen, *counts) if counts else df).write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    return (written, seen.get) if counts else written


def fk_graph_summary(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """(table_id, in_degree, island): edges that point at each table, and whether no edge touches it."""
    degree = edges.groupBy(F.col("parent").alias("table_id")).agg(F.count("*").alias("in_degree"))
    touched = edges.select(F.col("child").alias("table_id")).union(edges.select("parent")).distinct().withColumn("touched", F.lit(True))
    out = tables.select("table_id").distinct().join(degree, "table_id", "left").join(touched, "table_id", "left")
    return out.select("table_id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.col("touched").isNull().alias("island"))


def fk_resolve(edges: DataFrame, keys: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """edges (edge_id, parent, parent_cols array<int> or NULL, width) with the parent's columns and whether they are an exact key.

    Given columns must be as many as the child's, and the parent must have them all. Without them (NULL or empty), the first
    unique key of the width is taken. keys: table_id, key_no, cols. columns: table_id, cols, those that a table has; without it, given columns
    are taken to exist. resolved_cols is NULL and exact_key false where nothing fits.
    """
    c = F.col
    named = F.size("parent_cols") > 0
    keys = keys.select(c("table_id").alias("parent"), "key_no", c("cols").alias("key_cols"), F.size("cols").alias("key_width"))
    fits = edges.join(keys, (edges.parent == keys.parent) & (edges.width == keys.key_width), "left").drop(keys.parent)
    exact = ~F.coalesce(named, F.lit(False)) | (c("key_cols") == c("parent_cols"))
    best = fits.withColumn("_k", F.when(c("key_cols").isNotNull() & exact, F.struct("key_no", "key_cols")))
    best = best.groupBy("edge_id", "parent", "parent_cols", "width").agg(F.min("_k")["key_cols"].alias("key_cols"))
    known = F.lit(True)
    if columns is not None:
        best = best.join(columns.select(c("table_id").alias("parent"), c("cols").alias("has")), "parent", "left")
        known = F.coalesce(F.size(F.array_except("parent_cols", "has")) == 0, F.lit(False))
    given = F.when((F.size("parent_cols") == c("width")) & known, c("parent_cols"))
    resolved = F.when(F.coalesce(named, F.lit(False)), given).otherwise(c("key_cols"))
    return best.select("edge_id", "parent", "width", resolved.alias("resolved_cols"), (resolved.isNotNull() & c("key_cols").isNotNull()).alias("exact_key"))


def fk_plan_status(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """(edge_id, status) of the edges of planned children: external, unsupported or emitted.

    edges: edge_id, child, child_cols array<int>, parent, parent_cols array<int>, the parent's resolved columns or NULL. tables: table_id, rows, cols.
    An edge is external if its parent isn't planned. It is unsupported if the parent is empty but the child isn't, a child
    column is unknown or there is none, the parent's columns aren't resolved or as many, or an emitted edge of a lower
    id has claimed one of its child columns for another parent column. Edges of children that aren't planned have no row.

    Claims are settled in rounds: an edge that no open one of a lower id disagrees with is emitted, and those that
    disagree with an emitted one go. The lowest open edge of each column goes in every round, mostly all of them in two.
    """
    c = F.col
    ends = lambda side: tables.select(c("table_id").alias(side), c("rows").alias(f"{side}_rows"), c("cols").alias(f"{side}_has"))
    rows = edges.join(ends("child"), "child").join(ends("parent"), "parent", "left")
    empty = (c("child_rows") > 0) & (c("parent_rows") == 0)
    unknown = (F.size("child_cols") < 1) | (F.size(F.array_except("child_cols", "child_has")) > 0)
    arity = c("parent_cols").isNull() | (F.size("parent_cols") != F.size("child_cols"))
    basic = F.when(c("parent_rows").isNull(), "external").when(F.coalesce(empty | unknown | arity, F.lit(True)), "unsupported").otherwise("emitted")
    rows = _cut(rows.select("edge_id", "child", "child_cols", "parent", "parent_cols", basic.alias("status")))
    links = rows.where("status = 'emitted'").select("edge_id", "child", "parent", F.explode(F.arrays_zip("child_cols", "parent_cols")).alias("m"))
    open_ = _cut(links.select("edge_id", "child", c("m.child_cols").alias("col"), F.struct("parent", c("m.parent_cols").alias("col")).alias("target")))
    at, decided = ["child", "col"], rows.select("edge_id", F.lit(True).alias("good")).where("false")
    while open_.take(1):
        firsts = open_.groupBy(*at, "target").agg(F.min("edge_id").alias("id"))
        lead = firsts.groupBy(*at).agg(F.min(F.struct("id", "target")).alias("lead"))
        other = firsts.join(lead, at).where(c("target") != c("lead.target")).groupBy(*at).agg(F.min("id").alias("other"))
        seen = open_.join(lead, at).join(other, at, "left")
        rival = F.when(c("target") == c("lead.target"), c("other")).otherwise(c("lead.id"))  # lowest id that wants another target
        good = seen.groupBy("edge_id").agg(F.every(F.coalesce(rival >= c("edge_id"), F.lit(True))).alias("good")).where("good")
        good = _cut(good)
        taken = open_.join(good, "edge_id", "left_semi").select(*at, c("target").alias("taken")).distinct()
        left = open_.join(good, "edge_id", "left_anti")
        bad = left.join(taken, at).where(c("target") != c("taken")).select("edge_id").distinct().withColumn("good", F.lit(False))
        decided = decided.union(good).union(bad)
        open_ = _cut(left.join(bad, "edge_id", "left_anti"))
    out = rows.join(decided, "edge_id", "left")
    return out.select("edge_id", F.when(c("good") == F.lit(False), "unsupported").otherwise(c("status")).alias("status"))


def fk_plan_summary(status: DataFrame) -> DataFrame:
    """One row: source_edges, emitted, external and unsupported edges of fk_plan_status; zeros for no edges."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return status.agg(F.count("*").alias("source_edges"), count("emitted"), count("external"), count("unsupported"))


#: A graph is taken apart as long as one node in so many moves.
FEW_MOVE = 4


class _Round(NamedTuple):
    links: DataFrame  # a, b, w: links at its start
    nodes: DataFrame  # node, base, state (source, sink, into, on or stays), target, w


def _ends(links: DataFrame) -> DataFrame:
    """(node, n_out, n_in, next, last): how many links leave and enter a node, and the end of the only one where it is one."""
    none = F.lit(None).cast(links.select(F.struct("b", "w")).schema[0].dataType)
    out = links.select(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.struct("b", "w").alias("next"), none.alias("last"))
    into = links.select(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), none.alias("next"), F.struct(F.col("a").alias("b"), "w").alias("last"))
    return out.union(into).groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.max("next").alias("next"), F.max("last").alias("last"))


def _far(df: DataFrame) -> DataFrame:
    """A side of a join that goes by a shuffle. A broadcast brings its rows to the driver first, and rounds of them add up."""
    return df.hint("merge")


def _contract(links: DataFrame, base: DataFrame | None = None) -> tuple[list[_Round], DataFrame, DataFrame | None, int]:
    """Takes a graph apart: the rounds, what links and (node, base) they leave, and the last round in which a cycle closed (-1: none).

    links: a, b, w. In a round, nodes without links in or out go, and about three eighths of those with one link in or out are merged into the node at its other end, chosen by hashes
    so that none of those is merged itself. Ways of any length shrink by that share in each round, trees likewise, so rounds grow with the logarithm of their
    size. What is left has two links in and out at every node; without base, it is also left when less than one node in FEW_MOVE moves, as a dense graph only frays then.

    Weights add up along merged links, the greatest of parallel ones counts, and base (the greatest weight of ways from nodes that went) goes along, so that the longest ways stay what they are. Without base, weights are left alone.
    """
    rounds, closed = [], -1
    links, base = _cut(links), base if base is None else _cut(base)
    while True:
        k = len(rounds)
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2)) == 1  # noqa: B023, E731
        ends = _ends(links)
        gone = F.when(F.col("n_in") == 0, "source").when(F.col("n_out") == 0, "sink")
        on, into = (F.col("n_out") == 1) & ~coin(F.col("next.b")), (F.col("n_in") == 1) & ~coin(F.col("last.b"))
        heads = gone.isNull() & coin(F.col("node"))
        state = F.coalesce(gone, F.when(heads & on, "on").when(heads & into, "into"), F.lit("stays"))
        other = F.when(F.col("state") == "on", F.col("next")).when(F.col("state") == "into", F.col("last"))
        nodes = ends.withColumn("state", state).withColumn("other", other).select("node", "state", F.col("other.b").alias("target"), F.col("other.w").alias("w"), ((F.col("n_out") == 1) | (F.col("n_in") == 1)).alias("open"))
        # whoever would be merged into a node that goes waits
        going = nodes.where(F.col("state").isin("source", "sink")).select(F.col("node").alias("target"), F.lit(True).alias("late"))
        nodes = nodes.join(_far(going), "target", "left")
        nodes = nodes.withColumn("base", F.lit(0).cast("long")) if base is None else nodes.join(_far(base), "node", "left")
        kept = F.col("late").isNull()
        moves = F.count(F.when(F.col("open") | F.col("state").isin("source", "sink"), 1)).alias("moves")
        nodes, seen = _cut(nodes.select("node", F.col("base"), F.when(kept, F.col("state")).otherwise("stays").alias("state"), F.when(kept, F.col("target")).alias("target"), F.when(kept, F.col("w")).alias("w"), "open"), moves, F.count("*").alias("all"))
        if not seen.get("moves") or (base is None and seen["moves"] * FEW_MOVE < seen["all"]):
            return rounds, links, base, closed
        side = lambda s: nodes.select(F.col("node").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("base", "state", "target", "w")))  # noqa: B023, E731
        rows = links.join(_far(side("a")), "a").join(_far(side("b")), "b")
        rows = rows if base is None else _cut(rows)
        a, b = F.col("a_state"), F.col("b_state")
        before, after = F.when(a == "into", F.col("a_w")).otherwise(0), F.when(b == "on", F.col("b_w")).otherwise(0)
        end = F.when(b == "on", F.col("b_target")).otherwise(F.col("b"))
        stay = (a != "source") & (b != "sink") & (a != "on") & (b != "into")
        merged = rows.where(stay).select(F.when(a == "into", F.col("a_target")).otherwise(F.col("a")).alias("a"), end.alias("b"), (F.col("w") + before + after).alias("w"))
        rounds.append(_Round(links, nodes))
        links, seen = _cut(merged.groupBy("a", "b").agg(F.max("w").alias("w")), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("loops"))
        links, closed = links.where("a <> b"), k if seen.get("loops") else closed
        if base is None:
            continue
        pushed = rows.where((b != "sink") & a.isin("source", "on", "into")).select(F.when(a == "on", F.col("b")).otherwise(end).alias("node"), (F.col("a_base") + F.col("w") + F.when(a == "on", 0).otherwise(after)).alias("base"))
        left = base.join(_far(nodes.where("state <> 'stays'")), "node", "left_anti")
        base = _cut(left.select("node", "base").union(pushed.join(_far(left), "node", "left_semi")).groupBy("node").agg(F.max("base").alias("base")))


def _spread(marks: DataFrame, links: DataFrame) -> DataFrame:
    """(node, mark): the greatest mark that reaches each node over links (a, b), its own included; each round goes one link further from what changed."""
    marks = _cut(marks)
    changed = marks
    while changed.take(1):
        sent = changed.join(links, changed.node == links.a).groupBy(F.col("b").alias("node")).agg(F.max("mark").alias("sent"))
        both = marks.join(_far(sent), "node", "left").select("node", F.greatest("mark", "sent").alias("mark"), (F.col("sent") > F.col("mark")).alias("more"))
        both = _cut(both)
        marks, changed = both.select("node", "mark"), both.where("more").select("node", "mark")
    return marks


def _trimmed(links: DataFrame) -> DataFrame:
    """links (a, b) without those of nodes that nothing leads to or that lead nowhere, until none is left."""
    n = F.count("*").alias("n")
    links, seen = _cut(links, n)
    while before := seen.get("n"):
        ends = links.select("a").intersect(links.select(F.col("b").alias("a")))
        links, seen = _cut(links.join(_far(ends), "a", "left_semi").join(_far(ends.select(F.col("a").alias("b"))), "b", "left_semi").select("a", "b"), n)
        if seen.get("n") == before:
            break
    return links


def _core_components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes on cycles of links (a, b), label being the same for those that reach each other.

    Each node learns the greatest node that reaches it; nodes with one such root that reach it back are a component. The rest goes to the next round. A
    round has as many rows as there are links, and as many steps as the longest way it looks at; _contract leaves it few and short ones.
    """
    links = _trimmed(links.select("a", "b"))
    found = links.select(F.col("a").alias("node"), F.col("a").alias("label")).where("false")
    while links.take(1):
        nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        roots = _spread(nodes.withColumn("mark", F.col("node")), links)
        inner = links.join(_far(roots.select(F.col("node").alias("a"), F.col("mark").alias("ra"))), "a").join(_far(roots.select(F.col("node").alias("b"), F.col("mark").alias("rb"))), "b").where("ra = rb").select("a", "b")
        inner = _cut(inner)
        # back from each root, over the links that stay among its nodes
        back = _spread(roots.select("node", (F.col("node") == F.col("mark")).cast("int").alias("mark")), inner.select(F.col("b").alias("a"), F.col("a").alias("b")))
        component = _cut(back.where("mark = 1").select("node").join(roots, "node").select("node", F.col("mark").alias("label")))
        found = found.union(component)
        gone = component.select(F.col("node").alias("a"))
        links = _trimmed(links.join(gone, "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b"))
    return _cut(found)


def _labels(links: DataFrame) -> DataFrame:
    """(node, label): nodes with one label reach each other; nodes without are alone, or give the others their label."""
    rounds, core, _, closed = _contract(links.withColumn("w", F.lit(0).cast("long")))
    labels, has_core = _core_components(core), bool(core.take(1))
    for r in reversed(rounds if has_core else rounds[: closed + 1]):
        now = r.nodes.select("node", "state", F.coalesce("target", "node").alias("at")).join(_far(labels.select(F.col("node").alias("at"), "label")), "at", "left")
        now = _cut(now.select("node", "state", F.coalesce("label", "at").alias("label")))
        a, b = (now.select(F.col("node").alias(s), F.col("state").alias(f"{s}_state"), F.col("label").alias(f"{s}_label")) for s in ("a", "b"))
        same = r.links.join(_far(a), "a").join(_far(b), "b").where("a_label = b_label")
        # a merged node is on a cycle with its target if the links at its other side lead there
        hits = same.where("b_state = 'on'").select(F.col("b").alias("node"), F.col("b_label").alias("label")).union(same.where("a_state = 'into'").select("a", "a_label"))
        labels = labels.union(_cut(hits.distinct()))
    return labels


def fk_cycles(edges: DataFrame) -> DataFrame:
    """(child, parent) of edges within a cycle; a table's link to itself is none. NULL ends have no edge, repeated edges are one.

    Ways and trees are taken apart in rounds that grow with the logarithm of their size, what is left is searched from the greatest nodes, and the rounds are
    then gone through backwards, if any closed a cycle. A round has as many rows as there are links, never all pairs of a component. Links from nodes that
    nothing leads to, or to nodes that lead nowhere, are left out first, so that graphs of two levels need no round.
    """
    links = _cut(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).where("a <> b").distinct())
    led_to, leads = links.select(F.col("b").alias("a")).distinct(), links.select(F.col("a").alias("b")).distinct()
    links = _cut(links.join(_far(led_to), "a", "left_semi").join(_far(leads), "b", "left_semi").select("a", "b"))
    labels = _labels(links)
    at = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"{s}_label"))
    both = links.join(_far(at("a")), "a", "left").join(_far(at("b")), "b", "left").where(F.coalesce("a_label", "a") == F.coalesce("b_label", "b"))
    return _cut(both.select(F.col("a").alias("child"), F.col("b").alias("parent")))


def hierarchy_cycles(links: DataFrame) -> DataFrame:
    """Nodes whose chain of parents returns to them. links: node, parent; of several parents of a node the least counts, NULL is none.

    Steps double each round, and only nodes stay that another one's steps lead to and whose own lead to one that stays, so rounds shrink. When none goes any more, each
    is where exactly one other's steps end: what is left are the cycles. Joins go by shuffles, as broadcasts would bring every round to the driver.
    """
    n = F.count("*").alias("n")
    up = links.where(F.col("node").isNotNull() & F.col("parent").isNotNull()).groupBy("node").agg(F.min("parent").alias("up"))
    jumps, seen = _cut(up, n)
    while before := seen.get("n"):
        led_to = jumps.select(F.col("up").alias("node")).distinct().hint("merge")
        kept = jumps.join(led_to, "node", "left_semi")
        jumps, seen = _cut(kept.select("node", F.col("up").alias("m")).join(jumps.select(F.col("node").alias("m"), "up").hint("merge"), "m").select("node", "up"), n)
        if seen.get("n") == before:
            break
    return jumps.select("node")


def fk_load_level(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """(table_id, level): 0 without parents, else one above the highest parent; tables on or behind a cycle get none. Edges of other tables than `tables` don't count.

    The longest way to a table is found as cycles are: ways are merged link by link, and levels come back in as many rounds. Cycles are one step that is longer than any way.
    """
    ids = _cut(tables.select(F.col("table_id").alias("node")).where("table_id IS NOT NULL").distinct())
    own = ids.withColumnRenamed("node", "a")
    links = edges.select(F.col("parent").alias("a"), F.col("child").alias("b")).where("a <> b").distinct().join(own, "a", "left_semi").join(own.withColumnRenamed("a", "b"), "b", "left_semi")
    links = _cut(links.select("a", "b"))
    cyclic = fk_cycles(links.select(F.col("a").alias("child"), F.col("b").alias("parent"))).select(F.col("child").alias("a"), F.col("parent").alias("b"))
    never = 1 << 60
    on_cycle = cyclic.select(F.col("a").alias("node")).distinct().withColumn("never", F.lit(never))
    base = ids.join(on_cycle, "node", "left").select("node", F.coalesce("never", F.lit(0)).cast("long").alias("base"))
    rounds, _, rest, _ = _contract(links.join(cyclic, ["a", "b"], "left_anti").withColumn("w", F.lit(1).cast("long")), base)
    levels = rest.select("node", F.col("base").alias("level"))
    for r in reversed(rounds):
        went, at = r.nodes.where("state <> 'stays'"), levels.select(F.col("node").alias("target"), F.col("level").alias("above"))
        first = went.where("state = 'source'").select("node", F.col("base").alias("level")).union(went.where("state = 'into'").join(at, "target").select("node", F.greatest("base", F.col("above") + F.col("w"))))
        levels = levels.union(_cut(first))
        ends = went.where(F.col("state").isin("sink", "on")).select(F.col("node").alias("b"), "base")
        ways = r.links.join(ends, "b", "left_semi").join(levels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.max(F.col("level") + F.col("w")).alias("way"))
        levels = levels.union(_cut(ends.join(ways, "b").select(F.col("b").alias("node"), F.greatest("base", "way").alias("level"))))
    return _cut(levels.where(F.col("level") < never).select(F.col("node").alias("table_id"), "level"))


def partition_rollup(nodes: DataFrame) -> DataFrame:
    """(root, leaves, largest_leaf) of each hierarchy whose root has parts. nodes: node, parent, rows; one parent for each node.

    Each node's pointer jumps to that of the node above, twice as far each round, until it is at the root. Nodes that
    only a cycle is above have no root and are left out.
    """
    up = nodes.select("node", F.coalesce("parent", "node").alias("up"))
    at, n, steps = _cut(up), nodes.count(), 1
    while steps < max(n, 1):
        further = at.select("node", F.col("up").alias("m")).join(at.select(F.col("node").alias("m"), "up"), "m").select("node", "up")
        moved = _cut(further)
        same = at.join(moved, ["node", "up"], "left_anti")
        at, steps = moved, steps * 2
        if not same.take(1):
            break
    inner = nodes.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
    roots = nodes.where(F.col("parent").isNull()).select(F.col("node").alias("up"))
    leaves = nodes.join(inner, "node", "left_anti").where(F.col("parent").isNotNull()).select("node", "rows")
    pairs = leaves.join(at, "node").join(roots, "up", "left_semi")
    return pairs.groupBy(F.col("up").alias("root")).agg(F.count("*").alias("leaves"), F.max("rows").alias("largest_leaf"))


def ancestor_flags(nodes: DataFrame) -> DataFrame:
    """(node, any_ancestor) of each node: whether any node above it, at any distance, has the flag. nodes: node, parent, flag; one parent for each node.

    Each round a node takes over what the node it points at has seen and points twice as far, so rounds grow with the
    logarithm of the depth; a node that has seen the flag or the top stops. A node in a cycle is above itself. A NULL flag is false, and so
    is a parent that isn't among the nodes. A parent of very many nodes is split by adaptive execution, as nodes are the left side of the joins.
    """
    c = F.col
    flags = nodes.select(c("node").alias("up"), F.coalesce("flag", F.lit(False)).alias("has"), F.lit(True).alias("known"))
    seen = F.coalesce("has", F.lit(False))
    first = nodes.select("node", c("parent").alias("up")).join(flags, "up", "left")
    onward = F.count_if(c("up").isNotNull()).alias("open")
    at, left = _cut(first.select("node", F.when(~seen & c("known"), c("up")).alias("up"), seen.alias("seen")), onward, F.count("*").alias("n"))
    steps, n = 1, left["n"]
    while left["open"] and steps <= n:
        far = at.select(c("node").alias("up"), c("up").alias("next"), c("seen").alias("more"))
        moved = at.join(far, "up", "left").select("node", F.when(~c("more"), c("next")).alias("up"), (c("seen") | F.coalesce("more", F.lit(False))).alias("seen"))
        at, left = _cut(moved, onward)
        steps *= 2
    return at.select("node", c("seen").alias("any_ancestor"))


def resolve_object_edges(edges: DataFrame, objects: DataFrame, tables: DataFrame) -> DataFrame:
    """(object_id, target_id, reason): a dependency's identity as object, else as table, else why it is neither.

    edges: object_id, target, in_scope. objects and tables: identity, id.
    """
    out = edges.join(objects.select(F.col("identity").alias("target"), F.col("id").alias("o")), "target", "left").join(tables.select(F.col("identity").alias("target"), F.col("id").alias("t")), "target", "left")
    found = F.coalesce("o", "t")
    return out.select("object_id", found.alias("target_id"), F.when(found.isNull(), F.when(F.col("in_scope"), "target-not-visible").otherwise("outside-selected-schema")).alias("reason")).distinct()
