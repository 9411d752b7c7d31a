"""Op 4: mixing sources to target weights. DataFrame operations only.

Each source's documents are laid end to end as a string of words and cut into blocks of a fixed length. Weights give every
source a share of all words; no source is read more often than `most` times, and what that leaves over is shared again by
weight. The words a source owes become slots: whole passes over its blocks, then a part of one more pass whose last slot is
cut, so that the quota is met to the word. Within a pass, slot k reads block perm(k), perm being a pseudorandom permutation
of the source and the pass.

Output shards have SLOTS_PER_SHARD slots, the last one what is left. Each slot of a shard draws its source, so a shard's source
counts are a multinomial draw. Over all shards such draws miss every quota by about the root of its slots; so sources drawn too
often give back evenly spaced ones of their slots, and sources drawn too rarely get these, permuted. What is then a source's
n-th slot, counted through the shards, is its slot n above. Slots and blocks are joined by (source, block index); no source is
one task's load, and nothing runs over all slots or shards in one task but counts of a source by shard.

Documents lie in their source in the order (bucket of the id's hash, id), so offsets are prefix sums over a bounded number of
buckets and then inside one bucket.

Cases: null or blank texts have no words and are taken 0 times; a null source is a source of its own, the last; rows without
doc_id lie in the order of their texts' hashes; repeated
rows count as often as they stand; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityloom.llm.common import settled, table, word_count

BLOCK = 1024
MOST = 3
BUCKET_ROWS, MOST_BUCKETS = 256, 65_536
SLOTS_PER_SHARD = 4096
ROUNDS = 32


def permuted(x: str, n: str, *seed: str) -> Column:
    """The place of x under a pseudorandom permutation of 0..n-1: rounds that swap x with its mirror at a keyed point, or not."""
    keys = ", ".join(seed)
    mirror = f"pmod(pmod(xxhash64('point', {keys}, r), {n}) - x, {n})"
    return F.expr(f"aggregate(sequence(1, {ROUNDS}), {x}, (x, r) -> if(xxhash64('swap', {keys}, r, greatest(x, {mirror})) % 2 = 0, {mirror}, x))")


def laid_out(docs: DataFrame, cols: list, block: int = BLOCK, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): rows have cols, the text's print, size, source's sid, source_size and target, and start, their first word's place in the source."""
    rows = docs.select(
        *cols,
        F.xxhash64("text").alias("print"),
        word_count(F.col("text")).alias("size"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))).alias("_source"),
        F.coalesce("doc_id", F.xxhash64("text")).alias("_spread"),
    )
    rows = settled(rows, "sizes")  # words are counted once
    buckets = min(MOST_BUCKETS, max(1, rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_spread"), F.lit(buckets)).cast("int")).drop("_spread")
    sums = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_n"))
    sources = settled(targets(sums.groupBy("_source").agg(F.sum("_n").alias("source_size")), block, most), "sources")
    before = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy("_source", "_bucket").orderBy("doc_id", "print").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.join(bases.join(sources.select("_source", "sid", "source_size", "target"), "_source"), ["_source", "_bucket"])
    return placed.withColumn("start", F.col("_base") + F.sum("size").over(inside) - F.col("size")).drop("_source", "_bucket", "_base"), sources


def targets(sizes: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """sizes (_source, source_size), a row a source -> with sid, weight, target and what its slots need."""
    order = W.orderBy((F.col("_source") == "n"), "_source")
    s = sizes.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", F.col("sid") % 3 + 1)
    # the level at which min(weight * level, most * size) sums to all words: sources whose cap comes first, by cap over weight
    s = s.withColumn("_cap", F.col("source_size") * most).withColumn("_at", F.col("_cap") / F.col("weight"))
    by_cap = W.orderBy("_at", "sid").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("_at", "sid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(by_cap), F.lit(0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0))
    s = s.withColumn("_level", left / weight)
    level = F.first(F.when(F.col("_level") <= F.col("_at"), F.col("_level")), ignorenulls=True).over(whole)
    s = s.withColumn("target", F.least(F.coalesce(level, F.col("_at")) * F.col("weight"), F.col("_cap").cast("double")))
    # a hair under a whole number is that number
    s = s.withColumn("quota", F.least(F.floor(F.col("target") + 1e-6), F.col("_cap")))
    s = s.withColumns({"whole": F.expr(f"source_size div {block}"), "tail": F.col("source_size") % block})
    s = s.withColumns({"blocks": F.expr("whole + if(tail > 0, 1, 0)"), "passes": F.expr("if(source_size > 0, quota div source_size, 0)")})
    s = s.withColumn("rest", F.expr("if(source_size > 0, quota % source_size, 0)"))
    s = s.withColumn("slots", F.expr(f"passes * blocks + (rest + {block - 1}) div {block}"))
    s = s.withColumn("first_slot", F.coalesce(F.sum("slots").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return s.withColumn("all_slots", F.sum("slots").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).drop("_cap", "_at", "_level", "weight")


def holder(x: str, firsts: str) -> str:
    """The place of the last of the ascending array firsts, which begins with 0, that is not above x."""
    return f"aggregate(sequence(1, 40), 0L, (at, k) -> if(at + shiftleft(1L, 40 - k) < size({firsts}) and {firsts}[cast(at + shiftleft(1L, 40 - k) as int)] <= {x}, at + shiftleft(1L, 40 - k), at))"


def drawn(sources: DataFrame, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """sources (sid, slots, first_slot, all_slots) -> shard, sid, n: the slots of each output shard that each source gets. A shard's counts
    sum to its length, a source's to its slots."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.max("all_slots"), F.lit(0))).first()[0]  # one number
    # sids count from 0 without gaps, so a place in the array is a sid
    firsts = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("sid", "first_slot"))), lambda s: s["first_slot"]).alias("f"))
    draw = spark.range(total).withColumn("f", firsts.scalar())
    # an empty source has no slots and the next one's first slot: the last place that isn't above is never it
    draw = draw.selectExpr(f"id div {per_shard} as shard", f"{holder(f'pmod(xxhash64({chr(39)}draw{chr(39)}, id), {max(total, 1)}L)', 'f')} as sid")
    counts = settled(draw.groupBy("shard", "sid").agg(F.count("*").alias("n")), "draw")
    sums = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    told = sources.select(F.col("sid").cast("long").alias("sid"), "slots").join(sums, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    told = told.withColumns({"over": F.greatest(F.col("got") - F.col("slots"), F.lit(0)), "under": F.greatest(F.col("slots") - F.col("got"), F.lit(0))})
    earlier = W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    told = told.withColumns({c: F.coalesce(F.sum(x).over(earlier), F.lit(0)) for c, x in (("over_first", "over"), ("under_first", "under"))})
    told = settled(told, "told")  # a row a source
    # of a source's `got` slots, counted through the shards, those give way at which floor(i * over / got) rises
    before = W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    met = counts.join(told, "sid").withColumn("_i", F.coalesce(F.sum("n").over(before), F.lit(0)))
    met = met.withColumns({"_a": F.expr("cast(_i as decimal(38, 0)) * over div got"), "_b": F.expr("cast(_i + n as decimal(38, 0)) * over div got")})
    kept = met.selectExpr("shard", "sid", "n - (_b - _a) as n")
    unders = told.agg(F.transform(F.array_sort(F.collect_list(F.struct("sid", "under_first"))), lambda s: s["under_first"]).alias("u"), F.sum("over").alias("given"))
    free = met.where("_b > _a").selectExpr("shard", "explode(sequence(over_first + _a, over_first + _b - 1)) as i")
    free = free.withColumn("u", unders.select("u").scalar()).withColumn("given", unders.select("given").scalar())
    free = free.withColumn("i", permuted("i", "given", "'free'")).selectExpr("shard", f"{holder('i', 'u')} as sid", "1L as n")
    return kept.unionAll(free).groupBy("shard", "sid").agg(F.sum("n").alias("n")).where("n > 0")


def slots(sources: DataFrame, block: int = BLOCK, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """A row a slot: shard, place in it, sid, pass, block, and the words read of the block from its start."""
    counts = settled(drawn(sources, per_shard), "counts")
    through = W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("shard").orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("shard")
    each = counts.withColumns({"_first": F.coalesce(F.sum("n").over(through), F.lit(0)), "_before": F.coalesce(F.sum("n").over(inside), F.lit(0)), "_length": F.sum("n").over(whole)})
    each = each.join(sources.drop("first_slot", "all_slots"), "sid").withColumn("_k", F.explode(F.expr("sequence(0L, n - 1)")))
    each = each.withColumn("_j", F.col("_first") + F.col("_k")).withColumns({"pass": F.expr("_j div blocks"), "_p": F.expr("_j % blocks")})
    each = each.withColumn("block", F.when(F.col("_p") < F.col("whole"), permuted("_p", "whole", "sid", "pass")).otherwise(F.col("_p")))
    here = f"if(block < whole, {block}L, tail)"
    each = each.withColumn("words", F.expr(f"least({here}, if(pass < passes, {here}, rest - _p * {block}))")).withColumn("full", F.expr(f"words = {here}"))
    each = each.withColumn("place", permuted("(_before + _k)", "_length", "'place'", "shard"))
    return each.select("shard", "place", "sid", "pass", "block", "words", "full")


def taken_parts(docs: DataFrame, cols: list, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """Every row's cols, size, sid, source_size, target, start, first_shard: the first output
    shard that reads of it, and parts: its word ranges lo to hi - 1 and how often the mix takes each."""
    rows, sources = laid_out(docs, cols, block, most)
    read = slots(sources, block).groupBy("sid", "block").agg(F.sum(F.col("full").cast("long")).alias("_whole"), F.coalesce(F.max(F.when(~F.col("full"), F.col("words"))), F.lit(0)).alias("_cut"), F.min("shard").alias("_shard"))
    names = rows.columns
    spans = rows.withColumn("block", F.explode(F.expr(f"if(size > 0, sequence(start div {block}, (start + size - 1) div {block}), array(-1L))")))
    spans = spans.withColumns({"_lo": F.expr(f"greatest(start, block * {block}) - start"), "_hi": F.expr(f"least(start + size, (block + 1) * {block}) - start")})
    met = spans.join(read.hint("merge"), ["sid", "block"], "left").withColumn("_mid", F.expr(f"greatest(_lo, least(_hi, block * {block} + coalesce(_cut, 0) - start))"))
    both = "filter(array(named_struct('lo', _lo, 'hi', _mid, 'times', coalesce(_whole, 0) + 1), named_struct('lo', _mid, 'hi', _hi, 'times', coalesce(_whole, 0))), p -> p.hi > p.lo and p.times > 0)"
    # (sid, start) is a row's own; rows without words share it, and are kept apart by counting them
    key = [c for c in names if c not in ("target", "source_size")]
    out = met.groupBy(*key).agg(F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.flatten(F.collect_list(F.when(F.col("block") >= 0, F.expr(both)))).alias("parts"), F.min("_shard").alias("first_shard"), F.count(F.when(F.col("block") < 0, 1)).alias("_same"))
    return out.withColumn("_again", F.explode(F.expr("sequence(1, greatest(_same, 1))"))).drop("_again", "_same")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row of docs as often as the mix takes it, each time with just the words it takes. n_chars, where
    there, is of the new text."""
    same = ["doc_id", "print"]
    nth = W.partitionBy(*same)
    parts = taken_parts(docs, ["doc_id", "source"])
    parts = parts.select("doc_id", "print", "parts", F.row_number().over(nth.orderBy("source", "start")).alias("nth")).where(F.size("parts") > 0)
    # the rows travel as one column, so that no name of theirs meets one of ours
    full = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("print"))
    full = full.withColumn("nth", F.row_number().over(nth.orderBy("row.source"))).withColumnRenamed("doc_id", "id")
    met = full.join(parts, F.col("id").eqNullSafe(F.col("doc_id")) & (full["print"] == parts["print"]) & (full["nth"] == parts["nth"])).select("row", "parts")
    met = met.withColumn("time", F.explode(F.expr("sequence(1, array_max(transform(parts, p -> p.times)))")))
    word = r"'([^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*)'"
    met = met.withColumn("words", F.expr(f"regexp_extract_all(row.text, {word}, 1)"))
    ranges = "array_sort(filter(parts, p -> p.times >= time))"
    text = F.expr(f"rtrim(array_join(flatten(transform({ranges}, p -> slice(words, cast(p.lo + 1 as int), cast(p.hi - p.lo as int)))), ''))")
    met = met.withColumn("taken", text)
    new = {"text": F.col("taken")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("taken").cast(docs.schema["n_chars"].dataType)
    return met.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = taken_parts(table(spark, sf_dir, "documents"), ["doc_id"])
    taken = F.expr("aggregate(parts, 0L, (a, p) -> a + (p.hi - p.lo) * p.times)")
    return parts.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "sid", "start", "first_shard")
