"""Column profiles over long cells (column_name, cell): nulls, lengths, frequencies, distinct values, ranges and styles.

Every function aggregates first by (column, value or length), which combines map-side, and then by column, so a table
of any size ends in a few rows by two shuffles of pre-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.functions.rounding import div, quantize_count, quantize_count_at_most, quantize_fraction, quantize_non_null_rows

#: Least rows for an estimate, and the share of distinct values from which a column is near-unique.
LEAST_ROWS, NEAR_UNIQUE = 128, (20, 19)
#: Bytes of a value that its style is judged by: the definition of a style, not a cap on rows.
STYLE_BYTES = 4096
#: Least bytes of a value and of a column for a payload label, and the share that compressed values need.
PAYLOAD_VALUE, PAYLOAD_COLUMN, PAYLOAD_SHARE = 4 << 10, 16 << 10, (3, 4)
#: Hex prefixes of compressed containers.
SIGNATURES = ("FFD8FF", "89504E470D0A1A0A", "474946383761", "474946383961", "504B0304", "504B0506", "504B0708", "1F8B", "28B52FFD", "04224D18", "FD377A585A00", "425A68", "377ABCAF271C", "526172211A0700", "526172211A070100", "4F676753", "664C6143", "1A45DFA3")
#: Image brands of ISO media files.
BRANDS = ("avif", "avis", "heic", "heix", "hevc", "hevx", "mif1", "msf1")
#: Octets of a value up to which it is counted by itself; a length and two hashes, which stand for a longer one, take no more.
SHORT = 24


def null_profile(cells: DataFrame) -> DataFrame:
    n, some = F.count("*"), F.count("cell")
    return cells.groupBy("column_name").agg(n.alias("n_rows"), (n - some).alias("n_nulls"), some.alias("n_non_null"), ((n - some) / n).alias("null_fraction"))


def nearest_rank(histogram: DataFrame, keys: list[str], value: str, count: str, percents: dict[str, int]) -> DataFrame:
    """Nearest-rank percentiles of a histogram (keys, value, count), one column for each of `percents`."""
    upto = F.sum(count).over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum(count).over(W.partitionBy(*keys))
    ranked = histogram.withColumn("_upto", upto).withColumn("_n", whole)
    return ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") >= div(F.col("_n") * p + 99, 100), F.col(value))).alias(name) for name, p in percents.items()))


def length_profile(cells: DataFrame) -> DataFrame:
    """(column_name, length_avg, length_p95) in octets: the mean halves up, the percentile by nearest rank."""
    lengths = cells.where(F.col("cell").isNotNull()).groupBy("column_name", F.octet_length("cell").cast("long").alias("len")).agg(F.count("*").alias("n"))
    total, n = F.sum(F.col("len") * F.col("n")), F.sum("n")
    mean = lengths.groupBy("column_name").agg(div(total + div(n, 2), n).alias("length_avg"))
    return mean.join(nearest_rank(lengths, ["column_name"], "len", "n", {"length_p95": 95}), "column_name")


def value_counts(cells: DataFrame) -> DataFrame:
    """(column_name, missing, frequency) for each distinct value of each column, NULL among them, without the values.

    A value of up to SHORT octets is counted by itself. A longer one is counted by its length and two 64-bit hashes, the
    second of which starts from another seed, so what is shuffled doesn't grow with the values. Two different long values of
    one length count as one if both hashes agree: for 10^12 distinct values that happens with a chance of about 10^-15.
    """
    size = F.octet_length("cell")
    long = lambda x: F.when(size > SHORT, x)
    key = {"short": F.when(size <= SHORT, F.col("cell")), "size": long(size), "h1": long(F.xxhash64("cell")), "h2": long(F.xxhash64(F.lit(1), "cell"))}
    counts = cells.select("column_name", *(x.alias(name) for name, x in key.items())).groupBy("column_name", *key).agg(F.count("*").alias("frequency"))
    return counts.select("column_name", (F.col("short").isNull() & F.col("size").isNull()).alias("missing"), "frequency")


def value_frequencies(cells: DataFrame) -> DataFrame:
    """(column_name, cell, frequency) of each value that isn't NULL: for results that show the values; counts alone come from value_counts."""
    return cells.where(F.col("cell").isNotNull()).groupBy("column_name", "cell").agg(F.count("*").alias("frequency"))


def frequency_histogram(cells: DataFrame) -> DataFrame:
    """(column_name, frequency, n_values): how many values occur so often."""
    return value_counts(cells).where(~F.col("missing")).groupBy("column_name", "frequency").agg(F.count("*").alias("n_values"))


def frequency_summary(histogram: DataFrame) -> DataFrame:
    """observed_distinct, non_null, f1, f2, frequency_max, top_value_fraction and collision_pairs of each column."""
    f, n = F.col("frequency"), F.col("n_values")
    return histogram.groupBy("column_name").agg(
        F.sum(n).alias("observed_distinct"),
        F.sum(f * n).alias("non_null"),
        F.sum(F.when(f == 1, n).otherwise(0)).alias("f1"),
        F.sum(F.when(f == 2, n).otherwise(0)).alias("f2"),
        F.max(f).alias("frequency_max"),
        (F.max(f) / F.sum(f * n)).alias("top_value_fraction"),
        F.sum(n * div(f * (f - 1), 2)).alias("collision_pairs"),
    )


def frequency_quantiles(histogram: DataFrame) -> DataFrame:
    return nearest_rank(histogram, ["column_name"], "frequency", "n_values", {"frequency_p50": 50, "frequency_p95": 95, "frequency_p99": 99, "frequency_max": 100})


def source_non_null(non_null: Column, rows: Column, source_rows: Column) -> Column:
    """Non-null rows scaled from a sample of `rows` to the source, halves up."""
    wide = non_null.cast("decimal(20,0)") * source_rows.cast("decimal(18,0)") + div(rows, 2)
    return div(wide.cast("decimal(38,0)"), rows.cast("decimal(20,0)")).cast("long")


def chao1(observed: Column, f1: Column, f2: Column, source: Column) -> Column:
    """Chao's lower bound of the distinct values of the source."""
    unseen = F.when(f2 > 0, div(f1 * f1, F.greatest(f2, F.lit(1)) * 2)).otherwise(div(f1 * F.greatest(f1 - 1, F.lit(0)), 2))
    return F.least(F.greatest(observed + unseen, observed), F.greatest(source, observed))


def birthday(non_null: Column, observed: Column, pairs: Column, source: Column) -> Column:
    """Distinct values of a near-unique column from its collisions, one fewer as a guard; NULL where it isn't near-unique."""
    whole = F.greatest(source, observed)
    spread = F.greatest(2 * (pairs - 1), F.lit(1))
    estimate = F.least(F.greatest(div(non_null * (non_null - 1) + spread - 1, spread), observed), whole)
    near = (non_null >= LEAST_ROWS) & (observed * NEAR_UNIQUE[0] >= non_null * NEAR_UNIQUE[1]) & (source > observed)
    return F.when(near, F.when(pairs <= 1, whole).otherwise(estimate))


def distinct_estimates(cells: DataFrame, source_rows: Column, biased: Column) -> DataFrame:
    """The summary with source_non_null, chao1, birthday, and the estimate that the evidence allows with its method.

    source_rows: rows of the source, by the summary's columns and n_rows; biased: whether the rows are a biased sample.
    Columns without a value have none.
    """
    return _estimated(column_summary(cells).where("non_null > 0"), source_rows, biased)


def _estimated(summary: DataFrame, source_rows: Column, biased: Column) -> DataFrame:
    summary = summary.withColumn("source_rows", source_rows).withColumn("biased", biased)
    summary = summary.withColumn("source_non_null", source_non_null(F.col("non_null"), F.col("n_rows"), F.col("source_rows")))
    c = F.col
    summary = summary.withColumn("chao1", chao1(c("observed_distinct"), c("f1"), c("f2"), c("source_non_null"))).withColumn("birthday", birthday(c("non_null"), c("observed_distinct"), c("collision_pairs"), c("source_non_null")))
    complete, few = c("source_rows") == c("n_rows"), c("non_null") < LEAST_ROWS
    pick = lambda *x: F.when(complete, x[0]).when(c("biased") & c("birthday").isNotNull(), x[1]).when(c("biased"), x[2]).when(few, x[3]).otherwise(x[4])
    estimate = pick(c("observed_distinct"), c("birthday"), c("observed_distinct"), c("observed_distinct"), c("chao1"))
    method = pick("complete", "birthday", "lower-bound-biased", "lower-bound-small", "chao1")
    return summary.withColumn("estimated_distinct", estimate).withColumn("method", method)


def column_summary(cells: DataFrame) -> DataFrame:
    """frequency_summary, frequency quantiles and n_rows of each column by one scan: cells are counted by value, NULL among them, and those counts by column."""
    c, f, n = F.col, F.col("frequency"), F.col("n_values")
    histogram = value_counts(cells).groupBy("column_name", "missing", "frequency").agg(F.count("*").alias("n_values"))
    known = F.when(~c("missing"), n).otherwise(0)
    histogram = histogram.withColumn("_upto", F.sum(known).over(W.partitionBy("column_name").orderBy("frequency").rangeBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum(known).over(W.partitionBy("column_name")))
    some = lambda x: F.when(~c("missing"), x)
    total = lambda x: F.coalesce(F.sum(some(x)), F.lit(0))
    rank = lambda p: F.min(some(F.when(c("_upto") >= div(c("_all") * p + 99, 100), f)))
    out = histogram.groupBy("column_name").agg(
        F.sum(f * n).alias("n_rows"),
        total(n).alias("observed_distinct"),
        total(f * n).alias("non_null"),
        total(F.when(f == 1, n).otherwise(0)).alias("f1"),
        total(F.when(f == 2, n).otherwise(0)).alias("f2"),
        F.max(some(f)).alias("frequency_max"),
        total(n * div(f * (f - 1), 2)).alias("collision_pairs"),
        *(rank(p).alias(f"frequency_p{p}") for p in (50, 95, 99)),
    )
    return out.withColumn("top_value_fraction", F.when(c("non_null") > 0, c("frequency_max") / c("non_null")))


def cardinality_profile(cells: DataFrame, source_rows: Column, biased: Column, bias_reason: str = "deterministic-first-n-rows", layout: str = "row") -> DataFrame:
    """The block of a column that is shared, for columns with rows and values; none has more rows than its source.

    sample_rows are the rows read, at most those of the source; non-null rows, distinct values and frequencies are on the grid and within
    their bounds; an estimate is at least the observed values and at most the source's rows, and equals them where
    nothing is estimated. complete_source_read: whether all of the source was read. source_rows and biased are columns over n_rows.
    """
    c = F.col
    full = _estimated(column_summary(cells), source_rows, biased)
    full = full.where((c("n_rows") > 0) & (c("source_rows") > 0) & (c("non_null") > 0)).withColumn("sample_rows", F.least("n_rows", "source_rows"))
    full = full.withColumn("non_null_rows", quantize_non_null_rows("n_rows", "sample_rows", "non_null")).withColumn("observed", quantize_count_at_most("observed_distinct", "non_null_rows"))
    unestimated = c("method").isin("complete", "lower-bound-biased", "lower-bound-small")
    estimated = F.when(unestimated, c("observed")).otherwise(F.greatest(c("observed"), quantize_count_at_most("estimated_distinct", "source_rows")))
    bounded = {name: quantize_count_at_most(name, "non_null_rows").alias(name) for name in ("frequency_p50", "frequency_p95", "frequency_p99", "frequency_max")}
    null_fraction = (c("sample_rows") - c("non_null_rows")) / c("sample_rows")
    complete = c("n_rows") >= c("source_rows")
    reason = F.when(c("biased"), bias_reason).otherwise("")
    return full.select("column_name", complete.alias("complete_source_read"), "sample_rows", "non_null_rows", c("observed").alias("observed_distinct"), estimated.alias("estimated_distinct"), quantize_fraction("top_value_fraction").alias("top_value_fraction"), *bounded.values(), null_fraction.alias("null_fraction"), "method", F.lit(layout).alias("sample_layout"), c("biased").alias("sampled_with_bias"), reason.alias("bias_reason"))


def approx_distinct(cells: DataFrame, error: float = 0.02) -> DataFrame:
    """(column_name, approx_distinct, sketch): the sketch, of bounded size, can be united with those of other files."""
    return cells.groupBy("column_name").agg(F.approx_count_distinct("cell", error).alias("approx_distinct"), F.hll_sketch_agg("cell", 12).alias("sketch"))


def merge_sketches(files: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values over files from their sketches, which unlike their counts can be united."""
    return files.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_distinct"))


def unique_uplift(columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """columns whose estimate is the source's non-null rows where one plain unique key covers just this column.

    It is at least the observed values and at most the table's rows. indexes: table_id, cols array<int>, is_unique, expression, prefixed.
    columns: table_id, ordinal, observed_distinct, estimated_distinct, source_non_null, table_rows, method.
    """
    keys = indexes.where((F.size("cols") == 1) & F.col("is_unique") & ~F.col("expression") & ~F.col("prefixed")).select("table_id", F.col("cols")[0].alias("ordinal")).distinct().withColumn("unique_key", F.lit(True))
    out = columns.join(keys, ["table_id", "ordinal"], "left").withColumn("unique_key", F.coalesce("unique_key", F.lit(False)))
    lifted = F.when(F.col("unique_key"), F.least(F.greatest("source_non_null", "observed_distinct"), F.greatest("table_rows", "observed_distinct"))).otherwise(F.col("estimated_distinct"))
    return out.withColumn("estimated_distinct", lifted).withColumn("method", F.when(F.col("unique_key"), F.concat("method", F.lit("; unique constraint"))).otherwise(F.col("method")))


def value_range(df: DataFrame, keys: list[str], number: str, time: str) -> DataFrame:
    """Decimal exponents of the least and greatest size of a number, whether it is ever negative, and the span and last decade of a time."""
    exponent = F.when(F.col(number) != 0, F.floor(F.log10(F.abs(number)))).cast("long")
    days = F.datediff(F.max(time), F.min(time))
    span = F.when(days < 1, "intraday").when(days < 7, "days").when(days < 31, "weeks").when(days < 366, "months").when(days < 3653, "years").otherwise("decades")
    return df.groupBy(*keys).agg(F.min(exponent).alias("magnitude_min"), F.max(exponent).alias("magnitude_max"), F.max(F.col(number) < 0).alias("has_negative"), span.alias("time_span"), (F.floor(F.year(F.max(time)) / 10) * 10).cast("long").alias("time_recent_decade"))


def is_compressed(value: Column) -> Column:
    """Whether a binary value begins like a compressed container."""
    head = F.hex(F.substring(value, 1, 16))
    out = F.lit(False)
    for s in SIGNATURES:
        out = out | head.startswith(s)
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    return out | webp | ((F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin(*(b.encode().hex().upper() for b in BRANDS)))


def payload_profile(values: DataFrame) -> DataFrame:
    """(column_name, sampled_bytes, compressed_bytes, style): precompressed where large compressed values hold most bytes. values: (column_name, value binary)."""
    n = F.octet_length("value").cast("long")
    hit = (n >= PAYLOAD_VALUE) & is_compressed(F.col("value"))
    out = values.groupBy("column_name").agg(F.sum(F.coalesce(n, F.lit(0))).alias("sampled_bytes"), F.sum(F.when(hit, n).otherwise(0)).alias("compressed_bytes"))
    most = (F.col("compressed_bytes") > 0) & (F.col("sampled_bytes") >= PAYLOAD_COLUMN) & (F.col("compressed_bytes") * PAYLOAD_SHARE[1] >= F.col("sampled_bytes") * PAYLOAD_SHARE[0])
    return out.withColumn("style", F.when(most, "precompressed").otherwise(""))


def style_prefix(text: Column) -> Column:
    """The first STYLE_BYTES bytes of a text, without a code point cut in two."""
    head = F.call_function("make_valid_utf8", F.substring(F.encode(text, "utf-8"), 1, STYLE_BYTES).cast("string"))
    return F.when(F.octet_length(text) <= STYLE_BYTES, text).otherwise(F.regexp_replace(head, "\ufffd+$", ""))


def text_styles(texts: DataFrame, text: str) -> DataFrame:
    """texts with `style`, of the first bytes of a text: hex, base64, numeric-text, json, xml, natural-text or mixed; '' if empty, NULL for NULL.

    What a style looks at is computed in steps, once for each text, and only for texts that begin like it. Strings in JSON are dropped by
    two patterns, pairs of backslash and character and then quoted runs, neither of which recurses.
    """
    c, n = F.col, F.length("_s")
    rows = texts.withColumn("_s", style_prefix(c(text)))
    begun = F.regexp_replace("_s", r"^\s+", "")
    rows = rows.withColumn("_json", F.when(F.rlike("_s", F.lit(r"^\s*[{\[]")), F.regexp_replace(F.regexp_replace(begun, r"(?s)\\.", ""), r'"[^"]*"', "")))
    rows = rows.withColumn("_xml", F.when(F.rlike("_s", F.lit("^\\s*<[A-Za-z!?]")), begun))
    rows = rows.withColumn("_packed", F.rtrim("_s", F.lit(" \t\n\r")))
    times = lambda x: F.length("_json") - F.length(F.replace(c("_json"), F.lit(x), F.lit("")))
    json = c("_json").isNotNull() & (times(":") > 0) & (times("{") == times("}")) & (times("[") == times("]")) & (times('"') == 0)
    xml = c("_xml").startswith("<?xml") | (c("_xml").rlike("^<[A-Za-z!]") & c("_xml").contains(">"))
    letters, spaces, digits = (F.regexp_count("_s", F.lit(p)) for p in ("[A-Za-z]", "[ \t\n\r]", "[0-9]"))
    natural = (n >= 32) & (letters > div(n, 2)) & (spaces > 0) & (n - letters - spaces - digits < div(n, 4))
    packed = c("_packed")
    base64 = (F.length(packed) >= 16) & (F.length(packed) % 4 == 0) & packed.rlike("^[A-Za-z0-9+/=]+$") & packed.rlike("[A-Z]") & packed.rlike("[a-z]")
    out = F.when(n == 0, "").when((n >= 16) & (n % 2 == 0) & c("_s").rlike("^[0-9a-fA-F]+$"), "hex").when(base64, "base64")
    out = out.when(c("_s").rlike(r"^[0-9.,+eE \t\n\r-]+$") & c("_s").rlike("[0-9]"), "numeric-text")
    style = F.when(c("_s").isNotNull(), out.when(json, "json").when(xml, "xml").when(natural, "natural-text").otherwise("mixed"))
    return rows.withColumn("style", style).drop("_s", "_json", "_xml", "_packed")


def text_style_profile(cells: DataFrame) -> DataFrame:
    """(column_name, style, n): styles of the cells of each column. Cells with equal first bytes have one style and are counted first."""
    heads = cells.where(F.col("cell").isNotNull()).groupBy("column_name", style_prefix(F.col("cell")).alias("cell")).agg(F.count("*").alias("k"))
    return text_styles(heads, "cell").groupBy("column_name", "style").agg(F.sum("k").alias("n"))


def column_style(cells: DataFrame) -> DataFrame:
    """(column_name, style): the style of most cells of a column; mixed unless it is that of over half of them."""
    styles = text_style_profile(cells).where("style <> ''")
    best = styles.groupBy("column_name").agg(F.max_by("style", F.struct("n", "style")).alias("style"), F.max("n").alias("most"), F.sum("n").alias("all"))
    return best.select("column_name", F.when(F.col("most") * 2 > F.col("all"), F.col("style")).otherwise("mixed").alias("style"))
