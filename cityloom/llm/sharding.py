"""Op 3: rows to shards by a consistent-hash ring with virtual nodes and bounded loads. DataFrame operations only.

The ring has a fixed number of cells. A row belongs to the cell of its key's hash; each shard owns virtual nodes at
hashed cells. Cells are taken clockwise: a cell's rows go to the shard of the next virtual node as far as that shard has
room, and what is over goes on to the next shard clockwise that has room. A shard's room is its exact share of the rows,
so counts differ by one at most, and only rows of cells that overflow leave the shard that plain hashing gives them.

Only one fold is sequential, over the cells' row counts: its length is a parameter, not the number of rows. It goes group of
cells by group of cells, so that what each step copies is a group's pieces, not all before it. Rows themselves are ranked in
parallel: a cell is split by further bits of the hash into parts of some PART_ROWS rows, whose bases are prefix sums.

The law is `rows`: equal texts need not meet in a shard, as counts are equal whatever the groups. Where a document goes
depends on its id, not on its text.

Cases: a null text counts as empty; rows without key are spread by a hash of the columns kept, as their number has no bound;
rows that repeat a key share a part and get slots of their own; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityloom.llm.common import table, utf8

CELLS = 4_096
VNODES = 64
CELLS_AT_ONCE = 64
PART_ROWS = 1_024


def ring(spark: SparkSession, n_shards: int, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """One row, one column: the virtual nodes (pos, shard), clockwise."""
    node = spark.range(n_shards * vnodes, numPartitions=1).select(
        F.pmod(F.xxhash64(F.lit("vnode"), "id"), F.lit(cells)).cast("int").alias("pos"),
        F.xxhash64(F.lit("tie"), "id").alias("tie"),
        F.expr(f"cast(id div {vnodes} as int)").alias("shard"),  # a shard's nodes stay when shards are added
    )
    return node.agg(F.array_sort(F.collect_list(F.struct("pos", "tie", "shard"))).alias("ring"))


def plan(counts: DataFrame, n_shards: int, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """counts (cell, n), a row a cell -> pieces (cell, lo, n, shard, base): rows of rank lo to lo + n - 1 of the cell take the shard's slots from base."""
    nodes = ring(counts.sparkSession, n_shards, vnodes, cells)
    order = counts.withColumn("ring", nodes.scalar()).select(
        "cell", "n",
        F.expr("array_distinct(transform(concat(filter(ring, v -> v.pos >= cell), filter(ring, v -> v.pos < cell)), v -> v.shard))").alias("clockwise"),
    )
    one = order.agg(
        F.array_sort(F.collect_list(F.struct("cell", "n", "clockwise"))).alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")
    ).withColumn("room", F.expr(f"transform(sequence(0, {n_shards - 1}), s -> total div {n_shards} + if(s < total % {n_shards}, 1L, 0L))"))
    # the inner fold walks one cell clockwise; (left, lo) say what is still to be placed and from which rank on
    take = "least(w.left, element_at(w.room, s + 1))"
    walk = f"""aggregate(filter(c.clockwise, s -> element_at(acc.room, s + 1) > 0),
        named_struct('left', c.n, 'lo', 0L, 'room', acc.room, 'out', acc.out),
        (w, s) -> if(w.left = 0, w, named_struct(
            'left', w.left - {take}, 'lo', w.lo + {take},
            'room', transform(w.room, (r, i) -> if(i = s, r - {take}, r)),
            'out', concat(w.out, array(named_struct('cell', c.cell, 'lo', w.lo, 'n', {take}, 'shard', s,
                'base', element_at(full, s + 1) - element_at(w.room, s + 1)))))),
        w -> named_struct('room', w.room, 'out', w.out))"""
    empty = "cast(array() as array<struct<cell: int, lo: bigint, n: bigint, shard: int, base: bigint>>)"
    groups = f"transform(sequence(0, greatest(size(cells) - 1, 0), {CELLS_AT_ONCE}), i -> slice(cells, i + 1, {CELLS_AT_ONCE}))"
    group = f"aggregate(g, named_struct('room', all.room, 'out', {empty}), (acc, c) -> {walk}, acc -> named_struct('room', acc.room, 'out', concat(all.out, acc.out)))"
    folded = one.withColumn("full", F.col("room")).withColumn("groups", F.expr(groups)).select(
        F.expr(f"aggregate(groups, named_struct('room', room, 'out', {empty}), (all, g) -> {group}, all -> all.out)").alias("out")
    )
    return folded.select(F.explode("out").alias("p")).select("p.*")


def shard_rows(df: DataFrame, key: str, n_shards: int, keep: list, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """The columns keep of every row, with shard and slot. Slots of a shard run from 0 without gaps."""
    rows = df.select(*keep, F.col(key).alias("_key"))
    names = rows.columns[:-1]
    rows = rows.withColumn("_h", F.when(F.col("_key").isNull(), F.xxhash64(F.lit("row"), *names)).otherwise(F.xxhash64(F.lit("key"), F.col("_key"))))
    parts = max(1, -(-df.count() // (cells * PART_ROWS)))
    rows = rows.withColumn("_cell", F.pmod("_h", F.lit(cells)).cast("int")).withColumn("_part", F.pmod(F.expr(f"_h div {cells}"), F.lit(parts)).cast("int"))
    # a row a cell and part: how many rows there are, and how many in the cell's earlier parts
    sums = rows.groupBy("_cell", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("_cell").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = sums.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    pieces = plan(sums.groupBy(F.col("_cell").alias("cell")).agg(F.sum("_n").alias("n")), n_shards, vnodes, cells)
    # pieces: at most a row a cell and shard end, a bound that the parameters set
    at = F.broadcast(pieces.select(F.col("cell").alias("_cell"), "lo", F.col("n").alias("_m"), "shard", "base"))
    # where ranks of a part begin and end, piece by piece: a part meets few pieces
    spans = first.join(at, "_cell").where("_first < lo + _m and lo < _first + _n")
    spans = spans.groupBy("_cell", "_part", "_first").agg(F.array_sort(F.collect_list(F.struct("lo", "_m", "shard", "base"))).alias("_spans"))
    rank = F.row_number().over(W.partitionBy("_cell", "_part").orderBy("_h", "_key", *names)) - 1
    placed = rows.withColumn("_rank", rank.cast("long")).join(spans.hint("merge"), ["_cell", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    placed = placed.withColumn("_at", F.expr("filter(_spans, s -> _rank >= s.lo and _rank < s.lo + s._m)[0]"))
    return placed.select(*names, "_at.shard", F.expr("_at.base + _rank - _at.lo").alias("slot"))


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    data = utf8(F.col("text"))
    keep = ["doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")]
    out = shard_rows(docs, "doc_id", 16, keep)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
