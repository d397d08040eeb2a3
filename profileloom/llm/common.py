"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in HOT_SHARE; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Rows under which a key is never hot.
HOT_ROWS = 50
#: Parts into which the rows of a hot key are dealt in a join.
SALTS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Remembered(dict):
    """Results of a function by argument, of the last `size` to 2 * `size` arguments: when full, what is held becomes the old generation."""

    def __init__(self, function: Callable, size: int):
        self.function, self.size, self.old = function, size, {}

    def __missing__(self, key: object) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_model: dict[str, object] = {}


def on_worker(name: str, build: Callable[[], object]) -> object:
    """A model that a Python worker builds once; it holds one at a time, as workers outlive the stages of a session."""
    if name not in _model:
        _model.clear()
        gc.collect()
        _model[name] = build()
    return _model[name]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. For texts without other letters that is lower(), which is much faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def as_documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and nothing else, so that other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), *more)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names made of `names` that no column of df has, in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        out.append(new)
    return out


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, also of those that Spark doesn't hash (maps, variants), by their JSON."""
    plain = [f.dataType.simpleString() for f in df.schema.fields]
    odd = [any(word in t for word in ("map<", "variant")) for t in plain]
    whole = [F.to_json(F.struct(F.col(f"`{c}`"))) if o else F.col(f"`{c}`") for c, o in zip(df.columns, odd, strict=True)]
    return F.xxhash64(*whole)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where it names none, a folder of our own, but only on a local master."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder and goes on from there; lost executors then cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but as a compressed Parquet table, for rows with texts."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Takes the rows of tables of stored() that nothing reads any more off the disk, by writing none over them. Later reads of them fail."""
    for table in tables:
        for folder in {unquote(f).rpartition("/")[0] for f in table.inputFiles()}:
            table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(folder)


def hot_hashes(df: DataFrame, keys: list[str], rows: Column | None = None, total: Callable[[], int] | None = None) -> list[int]:
    """Hashes of the keys that hold over 1/HOT_SHARE of the rows: HOT_SHARE values at most, whatever the input.

    rows: the rows a row of df stands for; total: gives the rows that the share is of, if not those of df. Counts are
    combined before the shuffle, and the hash only decides how rows are dealt, never whether keys are equal.
    """
    counts = df.groupBy(F.xxhash64(*keys).alias("h")).agg(F.sum(rows if rows is not None else F.lit(1)).alias("n"))
    seen = Observation()  # the total comes with the same job
    top = counts.observe(seen, F.sum("n").alias("total")).orderBy(F.desc("n"), "h").limit(HOT_SHARE).collect()
    return [r.h for r in top if r.n >= HOT_ROWS and r.n * HOT_SHARE > (total() if total else seen.get["total"])]


def is_hot(keys: list[str], hot: list[int]) -> Column:
    return F.xxhash64(*keys).isin(hot) if hot else F.lit(False)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: list[int], spread: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which has each key once, on keys without nulls. Rows of hot keys are dealt over SALTS parts by `spread`."""
    if not hot:
        return left.join(right, keys, how)
    left = left.withColumn("_salt", F.when(is_hot(keys, hot), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    salts = F.when(is_hot(keys, hot), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = right.withColumn("_salt", F.explode(salts))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
