"""Synthetic tables from a profile: every value is an expression over a row number, so any partition of rows can be made anywhere."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profileloom.functions.rounding import Number, _col, div
from profileloom.operators.objects import padded
from profileloom.plans.permutation import permute_index, permuted

#: The calendar of generated dates has 28 days in a month; first years of dates and timestamps.
DAYS_PER_YEAR, DATE_YEAR, TIMESTAMP_YEAR, LAST_YEAR = 12 * 28, 2020, 2024, 9999
#: Per cent of a skewed column's values that take the median and the 95th percentile of its frequencies; the rest takes the 99th.
TAIL = (50, 45)
#: Parts that rows of a hot parent, or of none, are dealt over.
SALTS = 64
#: Bytes of a block of generated bytes, which is either drawn or the same everywhere, and of the bytes before them, which are the value's own.
BLOCK, OWN = 32, 8


class ColumnProfile(NamedTuple):
    name: str
    family: str  # integer, decimal, float, boolean, date, timestamp, text, hex, json, uuid, binary, vector
    distinct: int
    null_fraction: float = 0.0
    top_fraction: float = 0.0
    length_avg: int = 12
    length_p95: int = 12
    max_chars: int = 0
    frequencies: tuple[int, int, int] = (1, 1, 1)  # median, 95th and 99th percentile of its values' frequencies
    entropy: float | None = None  # 0 to 1: how far equal values are dealt, and how much of texts and bytes is drawn; None: all over, and as styles have it


def generation_plan(tables: DataFrame, scale: float, max_rows: int, prefix: str = "t") -> DataFrame:
    """(table_id, name, rows): rows scaled, halves up, at least 1 where the source has any and at most max_rows. Names follow the order of ids."""
    from pyspark.sql import Window as W

    wanted = F.floor(F.col("rows") * F.lit(float(scale)) + 0.5).cast("long")
    rows = F.when(F.col("rows") > 0, F.least(F.greatest(wanted, F.lit(1)), F.lit(max_rows))).otherwise(0)
    number = F.row_number().over(W.orderBy("table_id"))  # one row for each table of a profile
    return tables.select("table_id", F.concat(F.lit(prefix), padded(number, 4)).alias("name"), rows.cast("long").alias("rows"))


def scaled_distinct(distinct: Number | str, source_rows: Number | str, rows: Number | str) -> Column:
    """Distinct values for `rows` generated rows, halves up, within 1 and the rows."""
    d, s, r = _col(distinct), _col(source_rows), _col(rows)
    wide = d.cast("decimal(19,0)") * r.cast("decimal(18,0)") + div(s, 2)
    near = div(wide.cast("decimal(38,0)"), F.greatest(s, F.lit(1)).cast("decimal(19,0)")).cast("long")
    return F.when(r > 0, F.least(F.greatest(near, F.lit(1)), r)).otherwise(0)


def effective_distinct(estimated: Number | str, observed: Number | str, biased: Column, sample_rows: Number | str, non_null: Number | str, source_rows: Number | str) -> Column:
    """The source's distinct values: a near-unique lower bound of a biased sample is widened to the source's non-null rows."""
    e, o, s, n, r = (_col(x) for x in (estimated, observed, sample_rows, non_null, source_rows))
    near = biased & (n > 0) & (o * 20 >= n * 19) & (e <= o) & (s > 0)
    wide = div(r.cast("decimal(19,0)") * n.cast("decimal(18,0)") + div(s, 2), F.greatest(s, F.lit(1)).cast("decimal(19,0)")).cast("long")
    return F.least(F.greatest(F.when(near, F.greatest(e, wide)).otherwise(e), o), F.greatest(r, F.lit(1)))


def project_distribution(index: Number | str, rows: Number | str, distinct: Number | str, top: Number | str, p50: Number | str = 1, p95: Number | str = 1, p99: Number | str = 1) -> Column:
    """The domain value of a row, for 0 <= index < rows, so that every value of 0..distinct-1 occurs; distinct is at most the rows.

    Frequencies are even, if the 99th percentile is at most twice the median and the top share is none or that of any
    value: then equal values are runs. Else the first rows are value 0, with the share `top`; the next ones take every
    other value once; and the rest is dealt by weights: half of the values have the weight p50, 45 % have p95 and the others p99.
    Each argument may be a column; a NULL index gives NULL.
    """
    i, n, q50, q95, q99 = (_col(x).cast("long") for x in (index, rows, p50, p95, p99))
    share = _col(top).cast("double")
    domain = F.greatest(F.least(_col(distinct).cast("long"), n), F.lit(1).cast("long"))
    even = (q99 <= q50 * 2) & ((share <= 0) | (F.abs(share - 1.0 / domain) <= 0.01))
    length, longer = div(n, domain), n % domain  # so many runs are longer by one
    edge = longer * (length + 1)
    run = F.when(i < edge, div(i, length + 1)).otherwise(longer + div(i - edge, F.greatest(length, F.lit(1).cast("long"))))
    others = domain - 1
    hot = F.greatest(F.least(F.floor(n * share + 0.5).cast("long"), n - others), F.lit(1).cast("long"))
    left = F.greatest(n - hot - others, F.lit(1).cast("long"))
    few, some = (div(others * share, 100) for share in (TAIL[0], sum(TAIL)))
    low, mid, high = (F.greatest(x, F.lit(1).cast("long")) for x in (q50, q95, q99))
    first, second = few * low, few * low + (some - few) * mid
    whole = second + (others - some) * high
    at = F.least(F.floor((i - hot - others).cast("double") * whole / left).cast("long"), whole - 1)
    dealt = F.when(at < first, div(at, low)).when(at < second, few + div(at - first, mid)).otherwise(some + div(at - second, high)) + 1
    skewed = F.when((i < hot) | (others == 0), F.lit(0).cast("long")).when(i < hot + others, i - hot + 1).otherwise(dealt)
    return F.when(i.isNotNull(), F.when(even, run).otherwise(skewed))


def null_mask(table: str, column: str, index: Number | str, fraction: float) -> Column:
    """Whether a row is NULL: its hash on a grid of millionths falls under the fraction."""
    return F.pmod(F.xxhash64(F.lit(table), F.lit(column), _col(index)), F.lit(1_000_000)) < int(round(fraction * 1_000_000))


def value_length(index: Number | str, column: Number | str, avg: Number | str, p95: Number | str, cap: Number | str = 0) -> Column:
    """A row's length, by the profile's definition (fixed values): every 19th has the p95, and where row and column number sum to a multiple of 11 half the mean; else the mean."""
    i, k, avg, p95, cap = (_col(x) for x in (index, column, avg, p95, cap))
    skewed = F.when(i % 19 == 0, p95).when((i + k) % 11 == 0, F.greatest(div(avg, 2), F.lit(1))).otherwise(avg)
    size = F.when(p95 > avg, skewed).otherwise(avg)
    return F.greatest(F.when(cap > 0, F.least(size, cap)).otherwise(size), F.lit(1))


def gen_date(seed: Number | str) -> Column:
    n = _col(seed) % (DAYS_PER_YEAR * (LAST_YEAR - DATE_YEAR + 1))
    return F.make_date((DATE_YEAR + div(n, DAYS_PER_YEAR)).cast("int"), (div(n, 28) % 12 + 1).cast("int"), (n % 28 + 1).cast("int"))


def gen_timestamp(seed: Number | str) -> Column:
    s = _col(seed)
    day = div(s, 86_400) % (DAYS_PER_YEAR * (LAST_YEAR - TIMESTAMP_YEAR + 1))
    parts = [TIMESTAMP_YEAR + div(day, DAYS_PER_YEAR), div(day, 28) % 12 + 1, day % 28 + 1, div(s, 3_600) % 24, div(s, 60) % 60, s % 60]
    return F.make_timestamp(*(p.cast("int") for p in parts))


def gen_time(seed: Number | str) -> Column:
    s = _col(seed)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(div(s, 3_661) % 24), two(div(s, 61) % 60), two(s % 60))


def gen_integer(seed: Number | str, bits: int = 32, signed: bool = False) -> Column:
    """Distinct integers for distinct seeds within the width; signed ones take turns below zero."""
    s = _col(seed) % (1 << (bits - 1))
    return F.when(s % 2 == 1, -s).otherwise(s) if signed else s


def gen_decimal(seed: Number | str, precision: int, scale: int) -> Column:
    return ((_col(seed) % 10 ** min(precision, 18)).cast("decimal(38,0)") / F.lit(10**scale).cast("decimal(19,0)")).cast(f"decimal({precision},{scale})")


def unique_prefix(index: Number | str, value: Column, max_chars: int, digits: int = 6) -> Column:
    """A base-36 token of the row, _ and the value, cut to the width.

    The token has `digits` digits or as many as it needs. Where it doesn't fit, its last digits stay: they differ for
    36^max_chars rows in turn, which is all that the width can hold.
    """
    token = padded(F.lower(F.conv(_col(index).cast("string"), 10, 36)), digits)
    return F.when(F.length(token) >= max_chars, F.substring(token, -max_chars, max_chars)).otherwise(F.substring(F.concat(token, F.lit("_"), value), 1, max_chars))


#: Words of generated text.
WORDS = ("alpha", "river", "stone", "green", "market", "window", "silver", "garden", "paper", "number", "orange", "travel", "winter", "camera", "planet", "bridge")


def gen_year(seed: Number | str) -> Column:
    return (DATE_YEAR + _col(seed) % (LAST_YEAR - DATE_YEAR + 1)).cast("int")


def gen_bits(seed: Number | str, width: int) -> Column:
    """Text of `width` binary digits, distinct for distinct seeds within the width (62 at most)."""
    return F.lpad(F.bin(_col(seed).cast("long") % (1 << width)), width, "0")


def _drawn(seed: Column, k: Column, share: Column) -> Column:
    """Whether block k of a value is drawn: the start of a SHA-256 as a fraction falls under the share."""
    return F.conv(F.substring(F.sha2(F.concat_ws("/", seed.cast("string"), k.cast("string")), 256), 1, 4), 16, 10).cast("int") < share * 65_536


def _hexes(seed: Column, digits: Column, share: Column) -> Column:
    """At least so many hexadecimal digits: the value's own, then blocks that are drawn, with a probability, or the same for all."""
    same = F.lit(hashlib.sha256(b"0").hexdigest())
    block = lambda k: F.when(_drawn(seed, k, share), F.sha2(F.concat_ws(":", seed.cast("string"), k.cast("string")), 256)).otherwise(same)
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), div(digits.cast("long"), 2 * BLOCK)), block)
    return F.concat(F.substring(F.sha2(seed.cast("string"), 256), 1, 2 * OWN), F.array_join(blocks, ""))


def gen_text(seed: Number | str, length: Number | str, style: str = "natural-text", entropy: Number | str | None = None) -> Column:
    """Text of `length` characters in a style: natural-text, utf8-text, hex, numeric-text, base64, json or xml.

    It is distinct for distinct seeds as long as the seed, which comes first, fits. base64 is cut to whole groups of
    four characters, one at least; json and xml are longer than asked if their frame is.

    entropy, 0 to 1: in hex and numeric text the share of blocks that are drawn, others being the same for all seeds; None is 1. In texts of
    words, up to 0.5 twice the share of words that are drawn, others following a fixed order, and beyond it the share of drawn ones that are
    made of letters at random; None is 0.5.
    """
    s, n = _col(seed).cast("long"), _col(length).cast("int")
    e = F.least(F.greatest((F.lit(1.0 if style in ("hex", "numeric-text") else 0.5) if entropy is None else _col(entropy)).cast("double"), F.lit(0.0)), F.lit(1.0))
    token = F.lower(F.conv(s.cast("string"), 10, 36))
    words = F.array(*map(F.lit, WORDS))
    any_word = lambda k: F.element_at(words, (F.pmod(F.xxhash64(s, k), F.lit(len(WORDS))) + 1).cast("int"))
    any_letters = lambda k: F.translate(F.substring(F.sha2(F.concat_ws("-", s.cast("string"), k.cast("string")), 256), 1, 5), "0123456789", "ghijklmnop")
    grid = lambda k, salt: F.pmod(F.xxhash64(s, k, F.lit(salt)), F.lit(65_536))
    word = lambda k: F.when(grid(k, 1) >= e * 131_072, F.element_at(words, (k % len(WORDS) + 1).cast("int"))).when(grid(k, 2) < (e * 2 - 1) * 65_536, any_letters(k)).otherwise(any_word(k))
    body = F.array_join(F.transform(F.sequence(F.lit(0), div(n, 5).cast("int")), word), " ")
    fits = lambda taken: F.substring(body, F.lit(1), F.greatest(n - taken, F.lit(0)))
    if style == "json":
        return F.concat(F.lit('{"id":'), s.cast("string"), F.lit(',"note":"'), fits(F.length(s.cast("string")) + 17), F.lit('"}'))
    if style == "xml":
        return F.concat(F.lit("<r id='"), token, F.lit("'>"), fits(F.length(token) + 13), F.lit("</r>"))
    if style == "base64":
        taken = F.greatest(div(n, 4) * 3, F.lit(3)).cast("int")
        raw = F.rpad(F.concat(token, F.lit(" "), body), taken, " ")  # ASCII, so characters are bytes
        return F.regexp_replace(F.base64(F.encode(raw, "utf-8")), "[\r\n]", "")
    kinds = {
        "natural-text": lambda: F.concat(token, F.lit(" "), body),
        "utf8-text": lambda: F.concat(token, F.lit(" "), F.translate(body, "aeiou", "äéîöü")),
        "hex": lambda: F.concat(F.lower(F.hex(s)), _hexes(s, n, e)),
        "numeric-text": lambda: F.concat(s.cast("string"), F.translate(_hexes(s, n, e), "abcdef", "777777")),
    }
    return F.substring(kinds[style](), F.lit(1), n)


def gen_binary(seed: Number | str, length: Number | str, entropy: Number | str = 1.0) -> Column:
    """Bytes of a length: the value's own, then blocks that are drawn, with the entropy as probability, or the same for all seeds."""
    s, n = _col(seed).cast("long"), _col(length)
    return F.substring(F.unhex(_hexes(s, n * 2, _col(entropy).cast("double"))), F.lit(1), n.cast("int"))


def gen_uuid(seed: Number | str) -> Column:
    h = F.sha2(_col(seed).cast("string"), 256)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def gen_vector(seed: Number | str, dimensions: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(dimensions)), lambda k: (F.pmod(F.xxhash64(_col(seed), k), F.lit(20_001)) / 10_000 - 1).cast("float"))


def _value(p: ColumnProfile, domain: Column, k: int) -> Column:
    """The value of a domain value. Its length, too, depends on nothing else, so that equal ones stay equal."""
    length = value_length(domain, k, p.length_avg, p.length_p95, p.max_chars)
    bytes_ = gen_binary(domain, length, 1.0 if p.entropy is None else p.entropy)
    made = {"integer": gen_integer(domain), "decimal": gen_decimal(domain, 18, 2), "float": domain / 7.0, "boolean": domain % 2 == 1, "year": gen_year(domain), "bits": gen_bits(domain, 62), "date": gen_date(domain), "timestamp": gen_timestamp(domain), "uuid": gen_uuid(domain), "binary": bytes_, "vector": gen_vector(domain, 8)}
    return made[p.family] if p.family in made else gen_text(domain, length, {"text": "natural-text"}.get(p.family, p.family), p.entropy)


def generate_table(spark: SparkSession, table: str, rows: int, columns: Sequence[ColumnProfile], partitions: int | None = None) -> DataFrame:
    """A table of `rows` rows with the profiled nulls, distinct values, hot share, lengths and entropy; no shuffle, no state."""
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    return table_values(base, table, rows, columns).select(*(p.name for p in columns))


def table_values(base: DataFrame, table: str, rows: int, columns: Sequence[ColumnProfile]) -> DataFrame:
    """The columns of a table for the row numbers `id` in base, beside what base has. Equal values stand as far apart as the entropy of a column allows."""
    kept, index = [F.col(c) for c in base.columns], F.col("id")
    shuffled = permuted(base, "id", {f"_p{k}": (F.lit(rows), k + 1, F.lit(1.0 if p.entropy is None else p.entropy)) for k, p in enumerate(columns)})
    domains = shuffled.select(*kept, *(project_distribution(f"_p{k}", F.lit(rows), p.distinct, p.top_fraction, *p.frequencies).alias(f"_d{k}") for k, p in enumerate(columns)))
    return domains.select(*kept, *(F.when(~null_mask(table, p.name, index, p.null_fraction), _value(p, F.col(f"_d{k}"), k)).alias(p.name) for k, p in enumerate(columns)))


def gen_fk(child: DataFrame, index: str, child_rows: int, parent: DataFrame, parent_rows: int, coverage: float, hot: float, null_fraction: float = 0.0, fan_out: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """child with the parent's row for each child row, or NULL: `coverage` of the parents occur and one has the share `hot`.

    The others' fan-outs follow the median, 95th and 99th percentile given. parent: (row_index, ...). Composite keys come
    from one parent row, as the join is by its number. Rows of the hot parent and those without are dealt over SALTS parts.
    """
    covered = max(1, min(parent_rows, round(parent_rows * coverage)))
    at = project_distribution(permute_index(F.col(index), F.lit(child_rows), 7), F.lit(child_rows), min(covered, child_rows), hot, *fan_out)
    rows = child.withColumn("row_index", F.when(~null_mask("fk", "parent", F.col(index), null_fraction), at))
    none = F.lit(0).cast("long")
    salt = F.when(F.coalesce(F.col("row_index") == 0, F.lit(True)), F.pmod(F.xxhash64(index), F.lit(SALTS).cast("long"))).otherwise(none)
    salts = F.when(F.col("row_index") == 0, F.sequence(none, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(none))
    return rows.withColumn("_salt", salt).join(parent.withColumn("_salt", F.explode(salts)), ["row_index", "_salt"], "left").drop("_salt")


def roundtrip_error(source: DataFrame, made: DataFrame) -> DataFrame:
    """(column_name, null_error, distinct_error, top_error, length_error, length_p95_error) of two column profiles with those measures."""
    both = source.alias("s").join(made.alias("m"), "column_name", "full")
    gap = lambda c: F.abs(F.col(f"s.{c}") - F.col(f"m.{c}"))
    relative = lambda c: gap(c) / F.greatest(F.col(f"s.{c}"), F.lit(1))
    return both.select("column_name", gap("null_fraction").alias("null_error"), relative("observed_distinct").alias("distinct_error"), gap("top_value_fraction").alias("top_error"), relative("length_avg").alias("length_error"), relative("length_p95").alias("length_p95_error"))
