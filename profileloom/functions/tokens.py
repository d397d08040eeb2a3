"""Bands, type families, states, scores and keyed pseudonyms. Column to Column."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from profileloom.functions.rounding import Number, _col, div

#: Upper edges (excluded) and names of the bands; the last name is for the rest.
COUNT_BANDS = ((1, 2, 5, 9, 17, 33), ("0", "1", "2-4", "5-8", "9-16", "17-32", "33+"))
BYTE_BANDS = ((1, 256, 1024, 4096, 16384, 65536), ("0", "1-255", "256-1k", "1k-4k", "4k-16k", "16k-64k", "64k+"))
PERCENT_BANDS = ((25, 50, 75, 100), ("under-25pct", "25-49pct", "50-74pct", "75-99pct", "full"))

GIB = 1 << 30
CPU_BANDS = ((1, 2, 3, 5, 9, 17, 33, 65, 129), ("unknown", "1", "2", "3-4", "5-8", "9-16", "17-32", "33-64", "65-128", "129-plus"))
MEMORY_BANDS = ((1, 2 * GIB, 4 * GIB, 8 * GIB, 16 * GIB, 32 * GIB, 64 * GIB, 128 * GIB, 256 * GIB, 512 * GIB), ("unknown", "under-2-gib", "2-4-gib", "4-8-gib", "8-16-gib", "16-32-gib", "32-64-gib", "64-128-gib", "128-256-gib", "256-512-gib", "512-gib-plus"))
CONNECTION_BANDS = ((1, 2, 6, 21, 101, 501, 2001), ("none", "1", "2-5", "6-20", "21-100", "101-500", "501-2000", "2001-plus"))
RATE_BANDS = ((1, 11, 101, 1001, 10001), ("under-1", "1-10", "11-100", "101-1000", "1001-10000", "10000-plus"))

#: Native type names by family, of PostgreSQL.
TYPE_FAMILIES = {
    "boolean": ("boolean", "bool"),
    "smallint": ("smallint", "int2"),
    "integer": ("integer", "int4", "int"),
    "bigint": ("bigint", "int8", "long"),
    "real": ("real", "float4", "float"),
    "double precision": ("double precision", "float8", "double"),
    "date": ("date",),
    "time": ("time", "time without time zone", "time with time zone", "timetz"),
    "timestamp": ("timestamp", "timestamp without time zone", "timestamp_ntz"),
    "timestamptz": ("timestamp with time zone", "timestamptz"),
    "uuid": ("uuid",),
    "json": ("json", "jsonb"),
    "text": ("text", "varchar", "character varying", "character", "char", "name", "citext", "string"),
    "binary": ("bytea", "binary"),
    "vector": ("vector",),
}
#: Families of MySQL's type names.
MYSQL_FAMILIES = {
    "integer": ("tinyint", "smallint", "mediumint", "int", "integer", "bigint"),
    "numeric": ("decimal", "numeric"),
    "float": ("float", "real"),
    "double": ("double",),
    "boolean": ("bit", "bool", "boolean"),
    "year": ("year",),
    "date": ("date",),
    "time": ("time",),
    "timestamp": ("datetime", "timestamp"),
    "json": ("json",),
    "text": ("char", "varchar", "tinytext", "text", "mediumtext", "longtext", "enum", "set"),
    "binary": ("binary", "varbinary", "tinyblob", "blob", "mediumblob", "longblob", "geometry", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection"),
}
#: Families of SQL Server's type names.
MSSQL_FAMILIES = {
    "integer": ("bigint", "int", "smallint", "tinyint"),
    "numeric": ("decimal", "numeric", "money", "smallmoney"),
    "float": ("float", "real"),
    "boolean": ("bit",),
    "text": ("varchar", "char", "nvarchar", "nchar", "text", "ntext", "xml"),
    "binary": ("varbinary", "binary", "image", "geography", "geometry", "hierarchyid", "rowversion", "timestamp"),
    "uuid": ("uniqueidentifier",),
    "date": ("date",),
    "timestamp": ("datetime", "datetime2", "smalldatetime", "datetimeoffset"),
    "time": ("time",),
}


def band(x: Number | str, edges: Sequence[int], names: Sequence[str]) -> Column:
    """The name of the band that x falls in; NULL gives unknown."""
    x = _col(x)
    out = F.when(x.isNull(), "unknown")
    for edge, name in zip(edges, names, strict=False):
        out = out.when(x < edge, name)
    return out.otherwise(names[-1])


def count_band(x: Number | str) -> Column:
    return band(x, *COUNT_BANDS)


def byte_band(x: Number | str) -> Column:
    return band(x, *BYTE_BANDS)


def cpu_band(x: Number | str) -> Column:
    return band(x, *CPU_BANDS)


def memory_band(x: Number | str) -> Column:
    return band(x, *MEMORY_BANDS)


def connection_band(x: Number | str) -> Column:
    return band(x, *CONNECTION_BANDS)


def rate_band(x: Number | str) -> Column:
    """The band of a rate a second, rounded up from 1 on; none where nothing happens."""
    x = _col(x)
    return F.when(x <= 0, "none").otherwise(band(F.when(x < 1, 0).otherwise(F.ceil(x)), *RATE_BANDS))


def sample_fraction_band(rows: Number | str, sample: Number | str) -> Column:
    rows, sample = _col(rows), _col(sample)
    share = div(sample.cast("decimal(20,0)") * 100, F.when(rows != 0, rows).cast("decimal(20,0)"))
    return band(share, *PERCENT_BANDS)


def _family(head: Column, families: dict[str, tuple[str, ...]], out: Column | type) -> Column:
    for family, names in families.items():
        out = out.when(head.isin(*names), family)
    return out.otherwise("user-defined")


def normalize_type(native: Number | str, engine: Number | str = "postgresql") -> Column:
    """The family of a native type name of postgresql, mysql or mssql; engine is one of these names or a column of them, others are user-defined.

    Arguments are dropped, but numeric keeps its digits and arrays their element type in PostgreSQL, decimals their digits in SQL
    Server, and in MySQL more than one bit is binary. NULL types are user-defined.
    """
    text = F.lower(F.trim(_col(native)))
    head = F.regexp_extract(text, "^[a-z0-9_]+", 0)
    mysql = _family(head, MYSQL_FAMILIES, F.when((head == "bit") & text.rlike(r"\(\s*0*([2-9]|[1-9][0-9]+)\s*\)"), "binary"))
    digits = text.rlike(r"^(decimal|numeric)\([0-9,\s]+\)$")
    mssql = _family(head, MSSQL_FAMILIES, F.when(digits, F.regexp_replace(text, r"\s", "")))
    known = {"postgresql": _postgresql_family(text), "mysql": mysql, "mssql": mssql}
    if isinstance(engine, str) and engine in known:
        return known[engine]
    out = F
    for name, family in known.items():
        out = out.when(_col(engine) == name, family)
    return out.otherwise("user-defined")


def _postgresql_family(text: Column) -> Column:
    array, inner = text.endswith("[]"), F.regexp_replace(text, r"(\[\])+$", "")
    head = F.trim(F.regexp_replace(inner, r"(?s)\(.*$", ""))
    out = F.when(head.isin("numeric", "decimal"), F.when(inner.rlike(r"^(numeric|decimal)\([0-9, -]*\)$"), F.concat(F.lit("numeric"), F.regexp_replace(F.regexp_replace(inner, "^[a-z]+", ""), " ", ""))).otherwise("numeric"))
    out = _family(head, TYPE_FAMILIES, out)
    return F.when(array, F.concat(F.lit("array<"), out, F.lit(">"))).otherwise(out)


def stats_state(analyzed_at: Number | str, now: Number | str) -> Column:
    """fresh within 7 days, else stale; never_analyzed without a time."""
    at = _col(analyzed_at)
    return F.when(at.isNull(), "never_analyzed").when(F.timestamp_diff("SECOND", at, _col(now)) <= 7 * 86400, "fresh").otherwise("stale")


def evidence_state(applicable: Column, locked: Column, user_supplied: Column, analyzed_at: Column, stale: Column, reliable: Column) -> Column:
    """The state of a table's optimizer statistics; the first that holds counts.

    stale is what the source says of them, NULL if nothing; reliable: whether what it says can be used at all. NULL flags are false.
    """
    yes = lambda flag: F.coalesce(flag, F.lit(False))
    states = [(~F.coalesce(applicable, F.lit(True)), "not-applicable"), (yes(locked), "locked"), (yes(user_supplied), "user-supplied"), (analyzed_at.isNull(), "never-analyzed"), (yes(stale), "known-stale"), (stale.isNotNull(), "current"), (yes(reliable), "possibly-stale")]
    out = F
    for holds, name in states:
        out = out.when(holds, name)
    return out.otherwise("unknown")


def row_count_quality(external: Column, partitioned: Column, complete: Column, estimate: Column) -> Column:
    return F.when(external | partitioned, "unavailable").when(complete, "exact-read").when(estimate.isNotNull(), "estimate").otherwise("unavailable")


def scope_completeness(*states: Column) -> Column:
    """complete if all are, unknown if any is, else incomplete."""
    every, some = F.lit(True), F.lit(False)
    for s in states:
        every, some = every & (s == "complete"), some | (s == "unknown")
    return F.when(every, "complete").when(some, "unknown").otherwise("incomplete")


def column_score(c: dict[str, Column]) -> Column:
    """Points of evidence for a column, 100 at most. c: null_fraction, measured, biased, lower_bound, variable_width, length_rows, compressed."""
    null = c["null_fraction"]
    empty = F.coalesce(null == 1.0, F.lit(False))
    points = F.lit(25) + F.when(null.isNotNull(), 20).otherwise(0)
    points += F.when(empty, 40).when(c["measured"], F.when(c["biased"] | c["lower_bound"], 10).otherwise(25)).otherwise(0)
    points += F.when(~empty & (~c["variable_width"] | (c["length_rows"] > 0)), 15).otherwise(0)
    return F.least(F.lit(100), points + F.when(c["compressed"], 15).otherwise(0))


def entropy_from_ratio(ratio: Number | str) -> Column:
    """A step function from a compression ratio to an entropy between 0 and 1."""
    r = _col(ratio)
    return F.when(r <= 1.1, 1.0).when(r >= 32, 0.02).when(r >= 16, 0.06).when(r >= 8, 0.12).when(r >= 4, 0.22).when(r >= 2, 0.45).otherwise(0.75)


def keyed_hash(domain: str, columns: Sequence[Column], key: bytes, namespace: str = "profile") -> Column:
    """First 8 bytes, as hex, of the HMAC-SHA256 of the length-prefixed domain and components.

    The two padded keys are constants, so the hash runs in the JVM. NULL components count as empty.
    """
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in block).hex() for p in (0x36, 0x5C))

    def framed(c: Column) -> Column:
        raw = F.encode(F.coalesce(c.cast("string"), F.lit("")), "utf-8")
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw)

    message = F.concat(F.unhex(F.lit(namespace.encode().hex())), framed(F.lit(domain)), *map(framed, columns))
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message), 256)
    return F.substring(F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256), 1, 16)


def letters(n: Number | str) -> Column:
    """1 to A, 26 to Z, 27 to AA, and so on for any long; nothing for 0."""
    step = lambda x, _: F.when(x["left"] > 0, F.struct(div(x["left"] - 1, 26).alias("left"), F.concat(F.char((x["left"] - 1) % 26 + 65), x["made"]).alias("made"))).otherwise(x)
    start = F.struct(_col(n).cast("long").alias("left"), F.lit("").alias("made"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step)["made"]
