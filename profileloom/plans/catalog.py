"""All tables of a catalog: a plan in load order, and rows whose keys fit without a join.

A foreign key is a function of the child's row number: it gives a row of the parent, whose key is a function of that row's number in turn. So tables can
be made in any order and anywhere, also in cycles; the order is that in which a database can take them, its deferred edges last.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from math import prod
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.functions.rounding import div
from profileloom.operators.graph import _cut, fk_cycles, fk_load_level, fk_plan_status, fk_resolve
from profileloom.plans.generation import ColumnProfile, _value, gen_integer, generation_plan, null_mask, project_distribution, unique_prefix
from profileloom.plans.permutation import permute_batch, permuted

#: Characters of a generated key of text, unless its column is narrower.
KEY_CHARS = 16


class EdgeProfile(NamedTuple):
    coverage: float = 1.0  # share of the parents that occur
    hot: float = 0.0  # share of the children that one parent has
    null_fraction: float = 0.0
    fan_out: tuple[int, int, int] = (1, 1, 1)  # median, 95th and 99th percentile of the others


class CatalogPlan(NamedTuple):
    tables: DataFrame  # table_id, name, rows, level, load_order
    edges: DataFrame  # edge_id, child, child_cols, parent, parent_cols, exact_key, status
    keys: DataFrame  # table_id, key_no, cols: unique keys of the tables


def catalog_plan(tables: DataFrame, keys: DataFrame, edges: DataFrame, scale: float = 1.0, max_rows: int = 1 << 40, prefix: str = "t", selected: Sequence[object] | None = None, keep_cycles: bool = True) -> CatalogPlan:
    """Plans the tables selected (None: all): their names, rows and load order, and what becomes of each edge of a selected child.

    tables: table_id, rows, cols (ordinals). keys: table_id, key_no, cols. edges: edge_id, child, child_cols, parent, parent_cols (NULL: the parent's first
    unique key of the width). status is emitted, deferred (within a cycle of tables, so that the constraint comes after the rows), cycle (the
    same, if cycles aren't kept), external (the parent isn't selected) or unsupported: no such columns, no key, an empty parent, a column that an
    earlier edge has bound otherwise, or columns that refer to each other in a circle. level is 0 for tables without emitted parents, themselves aside, else one above
    the highest; load_order follows level and id. A name that isn't a table's raises; so does a repeated table_id.
    """
    if selected is not None:
        wanted = tables.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(selected)], f"table_id {dict(tables.dtypes)['table_id']}")
        if missing := [r[0] for r in wanted.join(tables, "table_id", "left_anti").limit(20).collect()]:
            raise ValueError(f"no such tables: {missing}")
        tables = tables.join(F.broadcast(wanted), "table_id", "left_semi")
    if twice := tables.groupBy("table_id").count().where("count > 1").take(1):
        raise ValueError(f"{twice[0][0]} is there more than once")
    planned = _cut(generation_plan(tables, scale, max_rows, prefix).join(tables.select("table_id", "cols"), "table_id"))
    own = edges.join(planned.select(F.col("table_id").alias("child")), "child", "left_semi")
    wide = own.select("edge_id", "parent", "parent_cols", F.size("child_cols").alias("width"))
    found = fk_resolve(wide, keys, tables.select("table_id", "cols")).select("edge_id", F.col("resolved_cols").alias("parent_cols"), "exact_key")
    bound = _cut(own.drop("parent_cols").join(found, "edge_id"))
    status = fk_plan_status(bound, planned)
    bound = _cut(bound.join(status, "edge_id"))
    good = bound.where("status = 'emitted'")
    # edges that close a cycle of tables, and those whose columns do, which no rows can fill
    cyclic = good.join(fk_cycles(good.select("child", "parent")), ["child", "parent"], "left_semi")
    parts = _cut(cyclic.select("edge_id", F.explode(F.arrays_zip("child_cols", "parent_cols")).alias("c"), "child", "parent"))
    at = lambda side: F.concat_ws("/", F.col(f"c.{side}_cols").cast("string"), F.col(side).cast("string"))
    links = parts.select("edge_id", at("child").alias("child"), at("parent").alias("parent"))
    circular = links.join(fk_cycles(links.select("child", "parent")), ["child", "parent"], "left_semi").select("edge_id").distinct().withColumn("circular", F.lit(True))
    marks = cyclic.select("edge_id").withColumn("cyclic", F.lit(True)).join(circular, "edge_id", "left")
    status = F.when(F.col("circular"), "unsupported").when(F.col("cyclic"), "deferred" if keep_cycles else "cycle").otherwise(F.col("status"))
    out = _cut(bound.join(marks, "edge_id", "left").withColumn("status", status).select("edge_id", "child", "child_cols", "parent", "parent_cols", "exact_key", "status"))
    levels = fk_load_level(planned, out.where("status = 'emitted'").select("child", "parent"))
    place = F.row_number().over(W.orderBy("level", "table_id"))  # one row for each table of a profile
    placed = planned.join(levels, "table_id").select("table_id", "name", "rows", "level", place.cast("long").alias("load_order"))
    return CatalogPlan(_cut(placed), out, keys.join(planned, "table_id", "left_semi"))


def plan_summary(plan: CatalogPlan) -> DataFrame:
    """One row: source_edges and how many of them are emitted, deferred, in omitted cycles, external and unsupported."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return plan.edges.agg(F.count("*").alias("source_edges"), *map(count, ("emitted", "deferred", "cycle", "external", "unsupported")))


class _Edge(NamedTuple):
    edge_id: object
    child: object
    parent: object
    cols: dict[int, int]
    stats: EdgeProfile


class _Catalog:
    """What generation looks up: rows of each table, the edge that binds a column, keys. As large as the profile, never as the tables."""

    def __init__(self, plan: CatalogPlan, columns: Mapping[object, Mapping[int, ColumnProfile]], stats: Mapping[object, EdgeProfile]):
        tables = plan.tables.orderBy("load_order").collect()
        self.rows, self.names, self.columns = {t.table_id: t.rows for t in tables}, {t.table_id: t.name for t in tables}, columns
        edges = plan.edges.where(F.col("status").isin("emitted", "deferred")).orderBy("edge_id").collect()
        self.edges = [_Edge(e.edge_id, e.child, e.parent, dict(zip(e.child_cols, e.parent_cols, strict=True)), stats.get(e.edge_id, EdgeProfile())) for e in edges]
        self.binding: dict[tuple, _Edge] = {}
        for e in self.edges:
            for c, p in e.cols.items():
                if (e.child, c) != (e.parent, p):  # a column refers to itself without further ado
                    self.binding.setdefault((e.child, c), e)
        self.keys: dict[object, list[list[int]]] = {}
        for k in plan.keys.orderBy("table_id", "key_no").collect():
            self.keys.setdefault(k.table_id, []).append(list(k.cols))

    def edge_radix(self, e: _Edge) -> tuple[int, int] | None:
        """(stride, base) of an edge in the first key that consists of foreign keys alone: distinct rows have distinct parents, taken together."""
        for key in self.keys.get(e.child, []):
            bound = [self.binding.get((e.child, c)) for c in key]
            if all(bound):
                edges = list({id(x): x for x in bound}.values())
                if e in edges:
                    bases = [self.rows[x.parent] for x in edges]
                    return prod(bases[: edges.index(e)]), bases[edges.index(e)]
        return None

    def column_radix(self, table: object, ordinal: int) -> tuple[int, int | None] | None:
        """(stride, base) of a column in the first key it is in. The last free column of a key has no base: with the others, or with foreign keys by itself, it tells rows apart."""
        for key in self.keys.get(table, []):
            free = [c for c in key if (table, c) not in self.binding]
            if ordinal in free:
                if len(free) < len(key):
                    return (1, None) if ordinal == free[-1] else None
                bases = [max(1, min(self.columns[table][c].distinct, self.rows[table])) for c in free]
                at = free.index(ordinal)
                return prod(bases[:at]), None if at == len(free) - 1 else bases[at]
        return None


def _parent_row(rows: DataFrame, catalog: _Catalog, e: _Edge, at: str, out: str) -> DataFrame:
    """rows with `out`, the parent's row number for the child's row number `at`; NULL for a NULL key and where `at` is NULL."""
    n, parents = catalog.rows[e.child], catalog.rows[e.parent]
    salt = e.edge_id if isinstance(e.edge_id, int) else zlib.crc32(str(e.edge_id).encode())
    kept, position, radix = [F.col(c) for c in rows.columns], f"_at{out}", catalog.edge_radix(e)
    # the edges of one key share their order
    rows = rows.select(*kept, F.when(F.col(at).isNotNull(), permute_batch(at, n, 0 if radix else salt)).alias(position))
    if radix:
        stride, base = radix
        value = div(F.col(position), F.lit(stride).cast("long")) % F.lit(base).cast("long")
    else:
        covered = max(1, min(parents, round(parents * e.stats.coverage)))
        value = project_distribution(position, F.lit(n), F.lit(min(covered, n)), F.lit(e.stats.hot), *e.stats.fan_out)
    rows = rows.select(*kept, value.alias(position))
    value = F.when(F.col(position).isNotNull(), permute_batch(position, parents, salt + 1))
    if e.stats.null_fraction and not radix:
        value = F.when(~null_mask(str(e.child), f"edge {e.edge_id}", at, e.stats.null_fraction), value)
    return rows.select(*kept, value.alias(out))


def _key_value(p: ColumnProfile, domain: Column, k: int) -> Column:
    """Values that differ wherever domains do, as far as the family and width can hold."""
    if p.family in ("integer",):
        return gen_integer(domain, 63)
    if p.family in ("text", "natural-text"):
        return unique_prefix(domain, _value(p, domain, k), p.max_chars or max(p.length_avg, KEY_CHARS))
    return _value(p, domain, k)


def _leaf(rows: DataFrame, catalog: _Catalog, table: object, ordinal: int, at: str, out: str) -> DataFrame:
    """rows with `out`, the value of a column that no edge binds, for the table's row number `at`."""
    p, n, kept, domain = catalog.columns[table][ordinal], catalog.rows[table], [F.col(c) for c in rows.columns], f"_d{out}"
    radix = catalog.column_radix(table, ordinal)
    if radix:
        stride, base = radix
        part = div(F.col(at), F.lit(stride).cast("long"))
        rows = rows.select(*kept, (part % F.lit(base).cast("long") if base else part).alias(domain))
        return rows.select(*kept, _key_value(p, F.col(domain), ordinal).alias(out))
    if p.entropy is None or p.entropy >= 1:
        rows = rows.select(*kept, permute_batch(at, n, ordinal + 1).alias(domain))
    else:
        rows = permuted(rows, at, {domain: (F.lit(n), ordinal + 1, F.lit(p.entropy))})
    rows = rows.select(*kept, F.when(F.col(at).isNotNull(), project_distribution(domain, F.lit(n), p.distinct, p.top_fraction, *p.frequencies)).alias(domain))
    return rows.select(*kept, F.when(~null_mask(str(table), p.name, at, p.null_fraction), _value(p, F.col(domain), ordinal)).alias(out))


def _table(spark: SparkSession, catalog: _Catalog, table: object) -> DataFrame:
    rows, steps, values = spark.range(catalog.rows[table]), {(): "id"}, {}
    for ordinal, p in sorted(catalog.columns[table].items()):
        path, at, column = (), table, ordinal
        while (at, column) in catalog.binding:
            e = catalog.binding[at, column]
            step = (*path, e.edge_id)
            if step not in steps:
                steps[step] = f"_r{len(steps)}"
                rows = _parent_row(rows, catalog, e, steps[path], steps[step])
            path, at, column = step, e.parent, e.cols[column]
        rows = _leaf(rows, catalog, at, column, steps[path], f"_v{ordinal}")
        values[p.name] = f"_v{ordinal}"
    return rows.select(*(F.col(v).alias(name) for name, v in values.items()))


def generate_catalog(spark: SparkSession, plan: CatalogPlan, columns: Mapping[object, Mapping[int, ColumnProfile]], stats: Mapping[object, EdgeProfile] | None = None) -> dict[object, DataFrame]:
    """A DataFrame for each table of the plan, in load order. columns: profiles by table and ordinal; stats: by edge.

    Columns of emitted and deferred edges hold what their parent's columns hold in one row of it, so composite keys come from one row, and
    chains of edges end in the same values. Unique keys hold, if families and widths can tell their rows apart: a key's free columns count rows through, a key
    of foreign keys alone counts combinations of parents, as many as there are, and holds if their own keys do. No join, no shuffle: each row follows from its number.
    """
    catalog = _Catalog(plan, columns, stats or {})
    return {t: _table(spark, catalog, t) for t in catalog.rows}


def write_catalog(plan: CatalogPlan, made: Mapping[object, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Writes each table to a folder of its planned name, parents before children."""
    for t in plan.tables.orderBy("load_order").collect():
        made[t.table_id].write.mode(mode).parquet(f"{path}/{t.name}")


def check_catalog(plan: CatalogPlan, made: Mapping[object, DataFrame], columns: Mapping[object, Mapping[int, ColumnProfile]]) -> DataFrame:
    """(kind, table_id, item, rows, held): each edge with its rows of non-NULL keys and those that have a parent; each unique key with its rows and how many differ."""
    names = lambda t, cols: [columns[t][c].name for c in cols]
    out = []
    for e in plan.edges.where(F.col("status").isin("emitted", "deferred")).collect():
        child, parent = (made[t].select(*(F.col(x).alias(f"k{i}") for i, x in enumerate(names(t, cols)))) for t, cols in ((e.child, e.child_cols), (e.parent, e.parent_cols)))
        if child.dtypes != parent.dtypes:
            child, parent = (df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)) for df in (child, parent))
        # rows are counted by key before the shuffle, so that no join sorts and moves all rows of a table
        sides = child.dropna().withColumn("n", F.lit(1).cast("long")).union(parent.dropna().withColumn("n", F.lit(0).cast("long")))
        keys = sides.groupBy(*child.columns).agg(F.sum("n").alias("n"), F.min("n").alias("there"))
        held = F.coalesce(F.sum(F.when(F.col("there") == 0, F.col("n"))), F.lit(0).cast("long"))
        out.append(keys.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows"), held.alias("held")).select(F.lit("edge").alias("kind"), F.lit(str(e.child)).alias("table_id"), F.lit(str(e.edge_id)).alias("item"), "rows", "held"))
    for k in plan.keys.collect():
        own = made[k.table_id].select(*names(k.table_id, k.cols))
        out.append(own.agg(F.count("*").alias("rows"), F.countDistinct(F.struct(*own.columns)).alias("held")).select(F.lit("key").alias("kind"), F.lit(str(k.table_id)).alias("table_id"), F.lit(str(k.key_no)).alias("item"), "rows", "held"))
    result = out[0] if out else plan.tables.select(F.lit("").alias("kind"), F.lit("").alias("table_id"), F.lit("").alias("item"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("held")).where("false")
    for x in out[1:]:
        result = result.union(x)
    return result
