"""Files as inputs of profiles, and profiles as files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.functions.tokens import normalize_type
from profileloom.operators.graph import _cut
from profileloom.operators.objects import label


#: Scheme and host of a path.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def scan_dataset(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A file or folder of Parquet, Avro, JSON, CSV or ORC files."""
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    return reader.load(path)


def profile_per_file(df: DataFrame, inputs: Sequence[str] = ()) -> DataFrame:
    """(table_id, file, n_rows): one logical table for each input file, numbered in path order. There is a row for each file, not for each row.

    A table that a writer split lies in a folder of as many files as it had tasks. A folder among inputs, the paths that df was read from, is one such table, and its
    files are parts of it; files of no such folder are tables of their own.
    """
    path = F.regexp_replace(F.col("_metadata.file_path"), _SCHEME, "")
    within = F.lit(None).cast("string")
    for root in sorted((re.sub(_SCHEME, "", p).rstrip("/") for p in inputs), key=len):  # the innermost folder counts
        either = [path.startswith(f"{r}/") for r in dict.fromkeys((root, quote(root)))]  # paths are given as they are or encoded
        within = F.when(reduce(or_, either), root).otherwise(within)
    files = df.groupBy(F.coalesce(within, F.col("_metadata.file_path")).alias("file")).agg(F.count("*").alias("n_rows"))
    number = F.row_number().over(W.orderBy("file"))
    return files.select(label("table", number).alias("table_id"), F.element_at(F.split("file", "/"), -1).alias("file"), "n_rows")


#: Schemes of stores from which a task reads the footers only.
RANGE_SCHEMES = ("file", "hdfs", "s3", "gs")
_FOOTER = "file string, column_name string, row_group int, n long, nulls long, packed long, raw long, codec string"


def _chunks(path: str, source: object) -> list[tuple]:
    """A row for each column chunk that a Parquet footer lists."""
    import pyarrow.parquet as pq

    meta, out = pq.ParquetFile(source).metadata, []
    for g in range(meta.num_row_groups):
        for k in range(meta.num_columns):
            c = meta.row_group(g).column(k)
            nulls = c.statistics.null_count if c.statistics is not None and c.statistics.has_null_count else None
            out.append((path, c.path_in_schema, g, c.num_values, nulls, c.total_compressed_size, c.total_uncompressed_size, c.compression))
    return out


def footer_rows(df: DataFrame) -> DataFrame:
    """(file, column_name, row_group, values, nulls, packed_bytes, raw_bytes, codec) from the footers of a Parquet table's files.

    Paths are dealt over tasks, which read the footers alone from stores that give ranges of files. From other stores
    Spark reads the files, one of them in a task's memory at a time.
    """
    import pyarrow as pa
    from pyarrow import fs

    spark, paths = df.sparkSession, df.inputFiles()
    names = ["file", "column_name", "row_group", "n", "nulls", "packed", "raw", "codec"]

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    out += _chunks(path, source)
            yield pd.DataFrame(out, columns=names).astype({"nulls": "Int64"})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [row for path, content in zip(batch["path"], batch["content"], strict=True) for row in _chunks(path, pa.BufferReader(content))]
            yield pd.DataFrame(out, columns=names).astype({"nulls": "Int64"})

    if all(p.split(":", 1)[0] in RANGE_SCHEMES for p in paths):
        listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // 32 + 1))
        rows = listed.mapInPandas(ranges, _FOOTER)
    else:
        rows = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(whole, _FOOTER)
    return rows.withColumnsRenamed({"n": "values", "packed": "packed_bytes", "raw": "raw_bytes"})


def storage_profile(df: DataFrame) -> DataFrame:
    """(column_name, row_groups, values, nulls, packed_bytes, raw_bytes, codecs, length_avg, ratio); nulls is NULL if any chunk lacks its count."""
    rows = footer_rows(df)
    some = F.count("nulls") == F.count("*")
    out = rows.groupBy("column_name").agg(F.count("*").alias("row_groups"), F.sum("values").alias("values"), F.when(some, F.sum("nulls")).alias("nulls"), F.sum("packed_bytes").alias("packed_bytes"), F.sum("raw_bytes").alias("raw_bytes"), F.array_join(F.array_sort(F.collect_set("codec")), ",").alias("codecs"))
    length = F.when(F.col("values") > 0, F.floor(F.col("raw_bytes") / F.col("values"))).otherwise(0)
    return out.withColumn("length_avg", length).withColumn("ratio", F.when((F.col("raw_bytes") > 0) & (F.col("packed_bytes") > 0), F.col("raw_bytes") / F.col("packed_bytes")).otherwise(0.0))


#: Folder of the manifest of a profile set: a row for each entity of each whole run.
MANIFEST = "manifest"


def write_profile(profile: dict[str, DataFrame], path: str, run_id: str, format: str = "parquet") -> None:
    """Writes each entity of a profile set to its own folder, partitioned by run; the run's lines in the manifest come last.

    A run that is repeated takes the place of its rows, and of nothing else. One that failed half-way has no lines, so read_profile doesn't see it.
    """
    if MANIFEST in profile:
        raise ValueError(f"{MANIFEST} can't be an entity")
    put = lambda df, name: df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").format(format).save(f"{path}/{name}")
    for entity, rows in profile.items():
        put(rows, entity)
    if profile:
        spark = next(iter(profile.values())).sparkSession
        put(spark.createDataFrame([(e,) for e in profile], "entity string").coalesce(1), MANIFEST)


def read_profile(spark: SparkSession, path: str, entity: str, format: str = "parquet") -> DataFrame:
    """Rows of an entity of the runs that are whole, with their run_id as text."""
    runs = spark.read.format(format).load(f"{path}/{MANIFEST}").where(F.col("entity") == entity).select(F.col("run_id").cast("string").alias("run_id"))
    rows = spark.read.format(format).load(f"{path}/{entity}")
    return rows.withColumn("run_id", F.col("run_id").cast("string")).join(runs, "run_id", "left_semi")


#: Index methods by engine; others are `other`.
INDEX_METHODS = {
    "postgresql": ("btree", "hash", "gin", "gist", "spgist", "brin"),
    "mysql": ("btree", "hash", "fulltext", "spatial", "rtree"),
    "sqlserver": ("heap", "clustered", "nonclustered", "xml", "spatial", "clustered columnstore", "nonclustered columnstore", "hash"),
}
#: Names that the type families know engines by.
TYPE_ENGINES = {"sqlserver": "mssql"}


def _field(v: Column | str, kind: str, *paths: str) -> Column:
    """The first of the paths in a variant that is there and can be read as the type."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{p}", kind) for p in paths))


#: What a snapshot's tables hold, and the items of their arrays.
_OF_TABLE = {"table_id": ("string", "oid"), "schema_name": ("string", "schema_name"), "table_name": ("string", "table_name"), "rows": ("double", "reltuples", "rows"), "table_bytes": ("long", "table_bytes"), "index_bytes": ("long", "index_bytes"), "last_analyze": ("string", "last_analyze")}
_ITEMS = {
    "columns": "attnum int, name string, type string, not_null boolean, avg_width long",
    "indexes": "name string, method string, unique boolean, is_unique boolean, col_ords array<int>, cols array<int>, seq int, col_name string",
    "fks": "fk_name string, fk_id string, name string, to_oid string, col_ords array<int>, cols array<int>, to_col_ords array<int>, to_cols array<int>, position int, seq int, col_name string, to_col_name string",
}


def _items(v: str, path: str) -> Column:
    """An array in a variant as structs; what has another type than it should is NULL. Only where that is so items are read field by field."""
    fields = [f.split() for f in _ITEMS[path].split(", ")]
    whole = F.try_variant_get(v, f"$.{path}", f"array<struct<{', '.join(f'{c}:{kind}' for c, kind in fields)}>>")
    return F.coalesce(whole, F.transform(F.try_variant_get(v, f"$.{path}", "array<variant>"), lambda x: F.struct(*(_field(x, kind, c).alias(c) for c, kind in fields))))


def catalog_snapshot(snapshots: DataFrame) -> dict[str, DataFrame]:
    """tables, columns, indexes and fk_edges from rows of JSON texts (column `snapshot`), one catalog each, as PostgreSQL, MySQL or SQL Server give them.

    A snapshot has engine, engine_version and tables, with oid, schema_name, table_name, reltuples or rows, table_bytes, index_bytes, last_analyze, columns (attnum, name, type,
    not_null, avg_width), indexes and fks. Keys come whole, in col_ords or cols and to_col_ords or to_cols, or a row for each of their columns, with seq or position, col_name and
    to_col_name; those are put together again, by name or fk_id and in order, and named columns get the ordinals of their tables. A key with
    a column that isn't there is NULL there; rows below 0 are 0. What has another type than it should is NULL, and a text that isn't JSON has no rows. Snapshots are told apart by
    snapshot_id, if `snapshots` has such a column, else by engine.

    Each text is parsed once and its tables are kept with their columns, indexes and keys, put together within each table. What follows reads those; only columns named of
    a key's parent take a join, of a row for each table.
    """
    own = "snapshot_id" if "snapshot_id" in snapshots.columns else "_engine"
    parsed = snapshots.withColumn("_v", F.try_parse_json("snapshot")).withColumn("_engine", _field("_v", "string", "engine"))
    parsed = parsed.select(F.col(own).cast("string").alias("snapshot_id"), F.col("_engine").alias("engine"), F.regexp_extract(_field("_v", "string", "engine_version"), r"[0-9]+([.][0-9]+)+", 0).alias("engine_version"), F.col("_v").alias("v"))
    at, key = ["snapshot_id", "engine", "table_id"], ["snapshot_id", "table_id"]
    tables = parsed.select("snapshot_id", "engine", "engine_version", F.explode(F.try_variant_get("v", "$.tables", "array<variant>")).alias("t"))
    read = tables.select("snapshot_id", "engine", "engine_version", *(_items("t", c).alias(f"_{c}") for c in _ITEMS), *(_field("t", kind, *paths).alias(c) for c, (kind, *paths) in _OF_TABLE.items()))
    columns_of = F.transform("_columns", lambda x: F.struct(x["attnum"].alias("ordinal"), x["name"].alias("name"), x["type"].alias("native_type"), (~x["not_null"]).alias("nullable"), x["avg_width"].alias("avg_width")))
    known = F.col("snapshot_id").isNotNull() & F.col("table_id").isNotNull()
    read = read.withColumns({"columns": columns_of, "_names": F.when(known, F.col("_columns.name")), "_ordinals": F.col("_columns.attnum")})
    ordinal = lambda names, ordinals, name: F.get(ordinals, (F.array_position(names, name) - 1).cast("int"))
    own_ordinal = lambda x: ordinal(F.col("_names"), F.col("_ordinals"), x["col_name"]).alias("o")
    in_parts = lambda x, *cols: F.coalesce(*(x[c] for c in cols)).isNull() & x["col_name"].isNotNull()

    def grouped(parts: str, made: Callable[[Column, Column], Column], *by: str) -> Column:
        """For each of the values of `by` among parts (seq, place, ...), what is made of them and its parts in order."""
        of = lambda x: F.struct(*(x[c].alias(c) for c in by))
        return F.transform(F.array_distinct(F.transform(parts, of)), lambda g: F.transform(F.array(F.filter(parts, lambda x: of(x) == g)), lambda own: made(g, own))[0])

    # indexes: whole ones, and a row for each of their columns
    whole = F.transform(F.filter("_indexes", lambda x: ~in_parts(x, "col_ords", "cols")), lambda x: F.struct(x["name"].alias("name"), F.lower(F.trim(x["method"])).alias("method"), F.coalesce(x["unique"], x["is_unique"]).alias("is_unique"), F.coalesce(x["col_ords"], x["cols"]).alias("cols")))
    part = lambda x, place: F.when(in_parts(x, "col_ords", "cols"), F.struct(x["seq"].alias("seq"), place.alias("place"), x["name"].alias("name"), F.lower(F.trim(x["method"])).alias("method"), F.coalesce(x["unique"], x["is_unique"]).alias("is_unique"), own_ordinal(x)))
    index_parts = F.sort_array(F.filter(F.transform("_indexes", part), lambda x: x.isNotNull()))
    # foreign keys likewise
    whole_fks = F.transform(F.filter("_fks", lambda x: ~in_parts(x, "col_ords", "cols")), lambda x: F.struct(F.coalesce(x["fk_name"], x["fk_id"], x["name"]).alias("name"), x["to_oid"].alias("parent"), F.coalesce(x["col_ords"], x["cols"]).alias("child_cols"), F.coalesce(x["to_col_ords"], x["to_cols"]).alias("parent_cols")))
    part_fk = lambda x, place: F.when(in_parts(x, "col_ords", "cols"), F.struct(F.coalesce(x["position"], x["seq"]).alias("seq"), place.alias("place"), F.coalesce(x["fk_name"], x["fk_id"], x["name"]).alias("name"), x["to_oid"].alias("parent"), own_ordinal(x), x["to_col_name"].alias("to_col_name")))
    fk_parts = F.sort_array(F.filter(F.transform("_fks", part_fk), lambda x: x.isNotNull()))
    read = read.withColumns({"whole": whole, "index_parts": index_parts, "fks": whole_fks, "fk_parts": fk_parts})
    put = grouped("index_parts", lambda g, own: F.struct(g["name"].alias("name"), F.get(F.filter(own, lambda x: x["seq"].isNotNull()), F.lit(0))["method"].alias("method"), F.array_max(own["is_unique"]).alias("is_unique"), own["o"].alias("cols")), "name")
    put_fks = grouped("fk_parts", lambda g, own: F.struct(g["name"].alias("name"), g["parent"].alias("parent"), own["o"].alias("child_cols"), own["to_col_name"].alias("to_names")), "name", "parent")
    kept = _cut(read.select("snapshot_id", "engine", "engine_version", *_OF_TABLE, "columns", "_names", "_ordinals", F.concat(F.coalesce("whole", F.array()), F.coalesce(put, F.array())).alias("indexes"), "fks", put_fks.alias("open_fks")))
    each = lambda c: kept.select(*at, F.explode(c).alias("x")).select(*at, "x.*")
    columns, indexes, put = each("columns"), each("indexes"), each("open_fks")
    engine = F.col("engine")
    for name, known in TYPE_ENGINES.items():
        engine = F.when(F.col("engine") == name, known).otherwise(engine)
    # families are found once for each type
    types = _cut(columns.select("engine", "native_type").distinct().withColumn("family", normalize_type("native_type", engine)))
    types = types.select(F.col("engine").alias("_e"), F.col("native_type").alias("_type"), "family")
    columns = columns.join(types, F.col("engine").eqNullSafe(F.col("_e")) & F.col("native_type").eqNullSafe(F.col("_type")), "left").drop("_e", "_type")
    method = F.lit("other")
    for name, known in INDEX_METHODS.items():
        method = F.when((F.col("engine") == name) & F.col("method").isin(*known), F.col("method")).otherwise(method)
    method = F.when(F.col("engine").isin(*INDEX_METHODS), method).otherwise(F.col("method"))
    # tables by (snapshot, id), which keys in parts name columns of; a repeated id has the columns of all. Ids hardly repeat, so a window, whose one sort
    # the join takes over, is cheaper than grouping them before and after the shuffle
    named = kept.where("size(_ordinals) > 0 AND _names IS NOT NULL").select(F.col("snapshot_id").alias("_s"), F.col("table_id").alias("_t"), F.col("_names").alias("n"), F.col("_ordinals").alias("o"))
    same = W.partitionBy("_s", "_t").orderBy("n", "o")
    every = F.collect_list(F.struct("n", "o")).over(same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    named = named.withColumns({"c": every, "_r": F.row_number().over(same)}).where("_r = 1").select("_s", "_t", F.flatten("c.n").alias("_n"), F.flatten("c.o").alias("_o"))
    put = put.join(named, (F.col("snapshot_id") == F.col("_s")) & (F.col("parent") == F.col("_t")), "left")
    put = put.select(*at, "name", "parent", "child_cols", F.transform("to_names", lambda n: ordinal(F.col("_n"), F.col("_o"), n)).alias("parent_cols"))
    edges = each("fks").unionByName(put)
    rows = F.when(F.col("rows") < 0, 0).otherwise(F.col("rows")).cast("long")
    return {
        "tables": kept.select("snapshot_id", "engine", "table_id", "schema_name", "table_name", rows.alias("rows"), "table_bytes", "index_bytes", F.try_to_timestamp("last_analyze").alias("analyzed_at"), "engine_version"),
        "columns": columns,
        "indexes": indexes.withColumn("method", method),
        "fk_edges": edges.select("snapshot_id", "engine", F.col("table_id").alias("child"), "parent", "child_cols", "parent_cols", "name"),
    }
