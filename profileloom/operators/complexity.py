"""Complexity of each object, assessed in seven dimensions from its definition, its requirements and the graph of dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profileloom.functions.tokens import BYTE_BANDS, COUNT_BANDS
from profileloom.operators.graph import fk_load_level

#: The dimensions, and the start of requirements that lead out of the database.
DIMENSIONS = ("volume", "control-flow", "feature-breadth", "entanglement", "environment-coupling", "opacity", "dialect-coupling")
EXTERNAL = "external."


def bucket(x: Column, edges: tuple[int, ...]) -> Column:
    """The place, from 0, of the band that x falls in; NULL for NULL."""
    out = F.lit(0)
    for edge in edges:
        out = out + (x >= edge).cast("int")
    return out


def object_graph(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(object_id, fan_out, unresolved, fan_in, depth) of objects (object_id) by edges (object_id, target_id, NULL if it isn't resolved).

    Repeated edges count once, unresolved ones each; targets that aren't objects count for the fan-out. depth is the longest way along dependencies, 0 without any, and NULL
    for objects on a cycle or that depend on one.
    """
    known = edges.where("object_id IS NOT NULL")
    links = known.where("target_id IS NOT NULL").select("object_id", "target_id").distinct()
    out = links.groupBy("object_id").agg(F.count("*").alias("fan_out"))
    loose = known.where("target_id IS NULL").groupBy("object_id").agg(F.count("*").alias("unresolved"))
    into = links.groupBy(F.col("target_id").alias("object_id")).agg(F.count("*").alias("fan_in"))
    ids = objects.select("object_id").where("object_id IS NOT NULL").distinct()
    inside = links.join(ids, "object_id", "left_semi").join(ids.select(F.col("object_id").alias("target_id")), "target_id", "left_semi")
    levels = fk_load_level(ids.withColumnRenamed("object_id", "table_id"), inside.select(F.col("object_id").alias("child"), F.col("target_id").alias("parent")))
    rows = ids.join(out, "object_id", "left").join(loose, "object_id", "left").join(into, "object_id", "left").join(levels.select(F.col("table_id").alias("object_id"), F.col("level").alias("depth")), "object_id", "left")
    # a link to itself is a cycle that levels don't see
    own = links.where("object_id = target_id").select("object_id", F.lit(True).alias("own"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.join(own, "object_id", "left").select("object_id", zero("fan_out"), zero("unresolved"), zero("fan_in"), F.when(F.col("own").isNull(), F.col("depth")).alias("depth"))


def assess_objects(objects: DataFrame, edges: DataFrame, requirements: DataFrame, census: DataFrame, dependencies_complete: bool = True) -> DataFrame:
    """(object_id, dimension, bucket, state) of every eligible object in all DIMENSIONS; state is assessed, not-applicable or unknown, and only assessed ones have a bucket, 0 to 6.

    objects: object_id, generated, secondary (by the engine; such objects aren't eligible), visibility (available, withheld or not_applicable), requirement_status, external
    (boolean). edges: object_id, target_id. requirements: object_id, token. census: key, status, size, complexity, opacity, n_features of language_census.
    Entanglement counts edges, resolved or not, if dependencies are complete. Couplings count requirements that start with EXTERNAL and an external object, and the other
    requirements, if their status is complete. NULL flags are false; objects without a census have unknown definitions.
    """
    c = F.col
    yes = lambda flag: F.coalesce(c(flag), F.lit(False))
    eligible = objects.where(c("object_id").isNotNull() & ~yes("generated") & ~yes("secondary"))
    links = edges.select("object_id", "target_id")
    n_edges = links.where("target_id IS NOT NULL").distinct().union(links.where("target_id IS NULL")).groupBy("object_id").agg(F.count("*").alias("n_edges"))
    outside = F.startswith(c("token"), F.lit(EXTERNAL))
    n_needs = requirements.groupBy("object_id").agg(F.count(F.when(outside, 1)).alias("n_outside"), F.count(F.when(~outside, 1)).alias("n_inside"))
    measures = census.select(c("key").alias("_key"), *(c(m).alias(f"_{m}") for m in ("status", "size", "complexity", "opacity", "n_features")))
    rows = eligible.join(n_edges, "object_id", "left").join(n_needs, "object_id", "left").join(measures, eligible.object_id.cast("string") == c("_key"), "left")
    count = lambda x: F.coalesce(c(x), F.lit(0))
    none, unknown = F.struct(F.lit("not-applicable").alias("state"), F.lit(None).cast("int").alias("bucket")), F.struct(F.lit("unknown").alias("state"), F.lit(None).cast("int").alias("bucket"))
    seen = lambda x, edges: F.when(x.isNotNull(), F.struct(F.lit("assessed").alias("state"), bucket(x, edges).alias("bucket"))).otherwise(unknown)
    of_text = lambda x, edges: F.when((c("visibility") == "not_applicable") | (c("_status") == "not_applicable"), none).when(c("_status").isin("complete", "partial"), seen(c(x), edges)).otherwise(unknown)
    of_needs = lambda x: F.when(c("requirement_status") == "complete", seen(x, COUNT_BANDS[0])).when(c("requirement_status") == "not_applicable", none).otherwise(unknown)
    observed = {
        "volume": of_text("_size", BYTE_BANDS[0]),
        "control-flow": of_text("_complexity", COUNT_BANDS[0]),
        "feature-breadth": of_text("_n_features", COUNT_BANDS[0]),
        "entanglement": seen(count("n_edges"), COUNT_BANDS[0]) if dependencies_complete else unknown,
        "environment-coupling": of_needs(count("n_outside") + yes("external").cast("int")),
        "opacity": of_text("_opacity", COUNT_BANDS[0]),
        "dialect-coupling": of_needs(count("n_inside")),
    }
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), observed[d].alias("o")) for d in DIMENSIONS))
    return rows.select("object_id", F.explode(each).alias("x")).select("object_id", "x.dimension", "x.o.bucket", "x.o.state")
