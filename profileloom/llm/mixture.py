"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profileloom.llm.common import cut, hot_hashes, row_hash, salted_join, text_or_empty, unused

#: Words in a block, and slots in a chunk of the schedule.
BLOCK, CHUNK = 128, 1 << 16
#: 2**31 over the golden ratio, made odd: i * STEP mod MODULUS visits every point and spreads any run of them evenly.
STEP, MODULUS = 1327217885, 1 << 31
#: Equal cells of the points, by which slots meet the source whose part they fall in.
CELLS = 1 << 12
#: Documents that a bucket of the shuffled order has on average, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 4096, 256

#: Slots in a shard of the mix.
RUN = 1 << 13

_BEFORE = (W.unboundedPreceding, -1)


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, limit: int) -> DataFrame:
    """source_no, source_size and target for rows (source, source_size): `share` times all sizes, dealt by weight like water.

    Sources take the weights in turn, in code point order, null last. A source stops at `limit` times its size and what
    it can't take is dealt to the others by weight. The windows are over as many rows as there are sources.
    """
    sizes = sizes.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = (F.pmod(F.col("source_no"), F.lit(len(weights))) + 1).cast("int")
    sizes = sizes.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn)).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    filling = W.orderBy(F.col("cap") / F.col("w"), "source_no").rowsBetween(*_BEFORE)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(filling), F.lit(0.0))
    level = rest / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(filling), F.lit(0.0)))
    sizes = sizes.withColumn("level", level)
    # in filling order, the first source that doesn't fill up sets the water level for itself and all that follow
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), "source_no", "level"))).over(whole)["level"]
    target = F.least(F.col("cap"), F.coalesce(first * F.col("w"), F.col("cap")))
    return sizes.select("source", "source_no", "source_size", target.alias("target"))


def schedule(targets: DataFrame, slots: int, limit: int) -> DataFrame:
    """(source_no, block, times, places): how often each block of each source is drawn whole in `slots` slots, and at which slot in each round.

    Slot i has the point i * STEP mod MODULUS, which falls into one source's part of the cumulative targets. The rank
    of a slot among the slots of its source names the block it draws, round after round. Ranks are counted within
    chunks of the schedule and the chunks' totals summed first, so no task holds all slots of a source. The points
    fall evenly, but not to the slot: a source stops at its quota of whole blocks (and one more if it gives part of a block), and
    blocks of the quota that the slots left undrawn are drawn after them, in slots of their own. So the quotas say how much
    of each source is in the mix, and the points where. targets: source_no, target, blocks, quota, part; places has `limit` items.
    """
    spark = targets.sparkSession
    upto = F.sum("target").over(W.orderBy("source_no"))
    whole = F.sum("target").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    parts = targets.where("target > 0").withColumn("high", F.floor(upto / whole * MODULUS)).withColumn("low", F.coalesce(F.lag("high").over(W.orderBy("source_no")), F.lit(0)))
    width = MODULUS // CELLS
    cells = F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))
    parts = parts.where("high > low").withColumn("cell", F.explode(cells)).select("cell", "low", "high", "source_no")
    point = F.pmod(F.pmod(F.col("id"), F.lit(MODULUS)) * F.lit(STEP), F.lit(MODULUS))
    drawn = spark.range(slots).select("id", F.expr(f"id div {CHUNK}").alias("chunk"), point.alias("point"))
    drawn = drawn.withColumn("cell", F.expr(f"point div {width}")).join(parts, "cell")
    drawn = drawn.where("point >= low and point < high").select("id", "chunk", "source_no")
    totals = cut(drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source_no").orderBy("chunk").rowsBetween(*_BEFORE)), F.lit(0))
    quotas = targets.withColumn("draws", F.col("quota") + F.when(F.col("part") > 0, 1).otherwise(0)).where("draws > 0").select("source_no", "blocks", "quota", "draws")
    chunks = totals.select("source_no", "chunk", before.alias("before")).join(quotas, "source_no")
    rank = F.row_number().over(W.partitionBy("source_no", "chunk").orderBy("id")) - 1
    ranks = drawn.withColumn("rank", rank).join(chunks, ["source_no", "chunk"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranks = ranks.where("rank < draws").select("source_no", "blocks", "quota", "rank", F.col("id").alias("place"))
    got = quotas.join(totals.groupBy("source_no").agg(F.sum("n").alias("n")), "source_no", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    late = got.where("n < draws").select("source_no", "blocks", "quota", "n", F.explode(F.expr("sequence(n, draws - 1)")).alias("rank"))
    late = late.select("source_no", "blocks", "quota", "rank", (F.col("rank") - F.col("n") + slots).alias("place"))
    places = [F.min(F.when(F.expr("rank div blocks") == r, F.col("place"))) for r in range(limit)]
    return ranks.union(late).groupBy("source_no", F.expr("rank % blocks").alias("block")).agg(F.count_if(F.expr("rank < quota")).alias("times"), F.array(*places).alias("places"))


def _plan(docs: DataFrame, weights: Sequence[int], share: float, limit: int, block: int, seed: int, rest: Column | None = None) -> DataFrame:
    """(row, rest, doc_id, size, source_size, target, rounds, places array<long>): one row for each row of docs; equal rows share `row` and what they have in `rest`."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    words = word_count(text_or_empty("text"))
    rows = docs.select(row_key().alias("row"), (F.lit(0).cast("long") if rest is None else rest).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), words.alias("size"))
    # rows that repeat in full are one row here, which stands for all of them
    rows = cut(rows.groupBy("row", "rest", "doc_id", "key", "size").agg(F.count("*").alias("copies")))
    totals = rows.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n"))
    source = F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1))
    sizes = cut(totals.withColumn("source", source).select("key", "source", "source_size", "n"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, limit)
    named = sizes.select(F.col("source").alias("s"), "key", "n")
    targets = targets.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    # a source gives `give` words: whole rounds of its blocks, then `quota` blocks in all and `part` words of the next
    give = F.round("target").cast("long")
    targets = targets.withColumn("give", give).withColumn("blocks", F.ceil(F.col("source_size") / block))
    over = F.expr("if(source_size > 0, give % source_size, 0)")
    quota = F.expr("if(source_size > 0, give div source_size, 0)") * F.col("blocks") + F.call_function("div", over, F.lit(block))
    targets = cut(targets.withColumn("quota", quota).withColumn("part", over % block))
    n, slots = targets.agg(F.sum("n"), F.sum("quota") + F.count_if(F.col("part") > 0)).first()
    buckets = max(LEAST_BUCKETS, (n or 0) // BUCKET_ROWS)
    given = targets.select("key", "source_no", "source_size", "target", "blocks", "quota", "part")
    rows = salted_join(rows, given, ["key"], hot_hashes(sizes, ["key"], F.col("n")), ["row"]).drop("key")
    rows = rows.withColumn("h", F.xxhash64("row", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    rows = rows.withColumn("mass", F.col("size") * F.col("copies"))
    before = F.coalesce(F.sum("in_bucket").over(W.partitionBy("source_no").orderBy("bucket").rowsBetween(*_BEFORE)), F.lit(0))
    ahead = rows.groupBy("source_no", "bucket").agg(F.sum("mass").alias("in_bucket")).select("source_no", "bucket", before.alias("before"))
    within = F.sum("mass").over(W.partitionBy("source_no", "bucket").orderBy("h", "row", "rest").rowsBetween(W.unboundedPreceding, 0)) - F.col("mass")
    rows = rows.withColumn("within", within).join(ahead, ["source_no", "bucket"])
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    start = F.col("before") + F.col("within") + F.col("copy") * F.col("size")
    kept = ["row", "rest", "copy", "doc_id", "size", "source_no", "source_size", "target", "start", "blocks", "quota", "part"]
    rows = rows.withColumn("start", start).select(*kept)
    spans = F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")
    pieces = rows.where("size > 0").withColumn("block", F.explode(spans))
    drawn = schedule(targets.select("source_no", "target", "blocks", "quota", "part"), slots or 0, limit)
    pieces = pieces.join(drawn, ["source_no", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    begin, end = F.greatest(F.col("start"), F.col("block") * block), F.col("start") + F.col("size")
    overlap = F.least(end, (F.col("block") + 1) * block) - begin
    last = F.when(F.col("quota") % F.col("blocks") == F.col("block"), F.col("part")).otherwise(0)
    partly = F.greatest(F.least(end, F.col("block") * block + last) - begin, F.lit(0))
    taken = [F.when(F.col("times") > r, overlap).when(F.col("times") == r, partly).otherwise(0) for r in range(limit)]
    first = [F.min(F.when(t > 0, F.col("places")[r])) for r, t in enumerate(taken)]
    some = pieces.groupBy(*kept).agg(F.array(*map(F.sum, taken)).alias("rounds"), F.array(*first).alias("places"))
    none = rows.where("size = 0").withColumn("rounds", F.array(*(F.lit(0).cast("long") for _ in range(limit)))).withColumn("places", F.array(*(F.lit(None).cast("long") for _ in range(limit))))
    return some.union(none).select("row", "rest", "doc_id", "size", "source_size", "target", "rounds", "places")


def row_key() -> Column:
    """SHA-256 of a row's doc_id, source and text: equal for rows that equal each other in all of them."""
    framed = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("doc_id", "source")]
    return F.unhex(F.sha2(F.concat(*(F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in framed), text_or_empty("text")), 256))


def _whole(docs: DataFrame) -> Column:
    """A hash of a row's columns besides doc_id, source and text; by their JSON too, as the plain hash passes over nulls."""
    named = [c for c in docs.columns if c.lower() not in ("doc_id", "source", "text")]
    if not named:
        return F.lit(0).cast("long")
    columns = [F.col(f"`{c}`") for c in named]
    return F.xxhash64(row_hash(docs.select(*columns)), F.to_json(F.struct(*columns)))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, limit: int = 2, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken, round_1 ... round_<limit> and place_1 ... place_<limit> for every row of `docs`.

    The documents of a source, in an order shuffled by hash, form one long row of words that is cut into blocks of
    `block` words; the schedule says how often each block is drawn, and the first words of one more block fill what is
    left, so a source of any size gives its target, to the word. taken is the number of the document's words so
    drawn, repeats counted; round_r those drawn in round r, which are always the first words of the document; place_r is
    the slot that draws them first, its place in the mix, null where the round takes nothing. No
    document exceeds `limit` times its size. Running sums are taken within buckets of the shuffled order and over the
    buckets' totals, so a source with most rows is dealt over many tasks.

    Null text has size 0 and takes nothing; null source is a source of its own; rows without id are mixed like others.
    Rows that are equal in doc_id, source and text are counted as one before any shuffle and told apart only by their
    places. An empty table gives no rows; columns other than doc_id, source and text aren't read.
    """
    plan = _plan(docs, weights, share, limit, block, seed)
    rounds = [F.col("rounds")[r].alias(f"round_{r + 1}") for r in range(limit)] + [F.col("places")[r].alias(f"place_{r + 1}") for r in range(limit)]
    taken = F.aggregate("rounds", F.lit(0).cast("long"), lambda done, x: done + x)
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *rounds)


def mixed_texts(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, limit: int = 2, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """The mix itself, with the columns of `docs`: for each round, every document with the words it takes in that round, in the schedule's order.

    A document that a round takes whole keeps its text as it is; one at the end of what its source gives is cut to
    the words taken, joined by spaces. n_chars, if there is one, follows the text. Null and empty texts take no words
    and aren't in the mix; null ids and sources are mixed like others. Of rows that are equal in doc_id, source and text, each
    takes one of their shares, in an order by a hash of the other columns, so reruns agree. Rows are dealt into shards of RUN
    slots that follow each other, and stand in them by place, so each shard has the sources in their proportions. An empty table gives no
    rows; columns of any name and type pass through.
    """
    plan = _plan(docs, weights, share, limit, block, seed, _whole(docs))
    row, rest, rank, n, take, round_, place = unused(docs, "row", "rest", "rank", "n", "take", "round", "place")
    shares = plan.select(F.col("row").alias(row), F.col("rest").alias(rest), F.explode(F.arrays_zip("rounds", "places")).alias(round_))
    shares = shares.where(F.col(round_)["rounds"] > 0)
    # of rows that are equal in all columns one is joined with all their shares, so the window's is the only shuffle of texts before the last
    rows = docs.withColumn(row, row_key()).withColumn(rest, _whole(docs))
    rows = rows.withColumn(rank, F.row_number().over(W.partitionBy(row, rest).orderBy(rest))).where(F.col(rank) == 1)
    rows = rows.join(shares, [row, rest]).withColumn(n, word_count(text_or_empty("text")))
    rows = rows.withColumn(take, F.col(round_)["rounds"]).withColumn(place, F.col(round_)["places"])
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut_text = F.array_join(F.slice(words, F.lit(1), F.col(take).cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col(take) == F.col(n), F.col("text")).otherwise(cut_text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    rows = rows.repartition(F.expr(f"`{place}` div {RUN}")).sortWithinPartitions(place, row, rest, take)
    return rows.select(*docs.columns)
