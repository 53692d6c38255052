"""Shards of bounded size by extendible hashing, in DataFrame operations only.

A row has 120 bits: 60 of its key's MD5, then 60 of its row number's, which tell copies of a key apart. A shard
is a prefix of these bits, and the directory maps prefixes to shards. All rows start in the shard of the empty
prefix. While a shard holds more than `max_bytes`, it splits on the next bit; shards that fit stay as they
are. So a row's shard is the shortest prefix of its bits whose rows fit together.

Only sizes are shuffled, summed per task before. The first round looks at a few more bits than evenly spread
bytes would need: sizes are summed at the longest prefix of the round, then up to every shorter one. Shards
that are still too large at the end of a round go on with more bits in the next one; the others are done.
The directory stays a table; a hot key is split by row numbers like any other shard.

A single row above the limit is a shard of its own, marked `oversized`. Null keys count as one key. Null and
empty texts have 0 bytes. Repeated rows are kept. An empty table has no shards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import keep

KEY_BITS = 60
ALL_BITS = 120
MORE_BITS = 12


def _bits(text) -> F.Column:
    """60 bits of a text's MD5, as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _prefix(depth: str) -> list:
    """The first `depth` bits (an SQL expression) of key_bits and row_bits, as two longs."""
    return [
        F.expr(f"shiftright(key_bits, greatest({KEY_BITS} - {depth}, 0))").alias("p1"),
        F.expr(f"CASE WHEN {depth} > {KEY_BITS} THEN shiftright(row_bits, {ALL_BITS} - {depth}) ELSE 0L END").alias("p2"),
    ]


def directory(rows: DataFrame, max_bytes: int) -> tuple[list[int], list[DataFrame]]:
    """For each round its longest depth and a table (p1, p2, depth, shard_bytes, shard_rows): the shard of every
    prefix of that depth which ended in this round. `rows` has key_bits, row_bits and n_bytes."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    first, longest = 0, min(KEY_BITS, max(1, (total // max_bytes).bit_length() + 3))
    depths, tables, left = [], [], rows
    while True:
        sums = left.groupBy(*_prefix(str(longest))).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"))
        sums = keep(sums, "sharding")
        # every prefix up to the longest one of this round, the longest's bits shifted out one by one
        at = F.explode(F.sequence(F.lit(first), F.lit(longest))).alias("depth")
        steps = sums.select("*", at).withColumns(
            {
                "s1": F.expr(f"shiftright(p1, greatest(least({longest}, {KEY_BITS}) - depth, 0))"),
                "s2": F.expr(f"CASE WHEN depth > {KEY_BITS} THEN shiftright(p2, {longest} - depth) ELSE 0L END"),
            }
        )
        sized = steps.groupBy("depth", "s1", "s2").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("shard_rows"))
        fits = sized.filter((F.col("shard_bytes") <= max_bytes) | (F.col("shard_rows") == 1) | (F.col("depth") == ALL_BITS))
        shortest = F.min(F.struct("depth", "shard_bytes", "shard_rows")).alias("shard")
        found = steps.select("p1", "p2", "depth", "s1", "s2").join(fits, ["depth", "s1", "s2"]).groupBy("p1", "p2").agg(shortest)
        found = keep(found.select("p1", "p2", "shard.*"), "sharding")
        depths.append(longest)
        tables.append(found)
        full = sums.join(found, ["p1", "p2"], "left_anti").select("p1", "p2")
        if longest == ALL_BITS or full.isEmpty():
            return depths, tables
        left = left.withColumns({x: c for x, c in zip(("p1", "p2"), _prefix(str(longest)))})
        left = keep(left.join(full, ["p1", "p2"], "left_semi").drop("p1", "p2"), "sharding")
        first, longest = longest + 1, min(ALL_BITS, longest + MORE_BITS)


def _with_bits(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    key = F.coalesce(df[key_col].cast("string"), F.lit(""))
    return df.select(
        "*",
        _bits(key).alias("key_bits"),
        _bits(F.monotonically_increasing_id().cast("string")).alias("row_bits"),
        F.coalesce(F.octet_length(df[text_col]), F.lit(0)).cast("long").alias("n_bytes"),
    )


def _assign(rows: DataFrame, max_bytes: int) -> DataFrame:
    depths, tables = directory(rows, max_bytes)
    parts, left = [], rows
    for depth, found in zip(depths, tables):
        left = left.withColumns({x: c for x, c in zip(("p1", "p2"), _prefix(str(depth)))})
        parts.append(left.join(found, ["p1", "p2"]).drop("p1", "p2"))
        if depth != depths[-1]:
            left = left.join(found, ["p1", "p2"], "left_anti").drop("p1", "p2")
    bits = F.concat(
        F.lpad(F.conv(F.col("key_bits").cast("string"), 10, 2), KEY_BITS, "0"),
        F.lpad(F.conv(F.col("row_bits").cast("string"), 10, 2), KEY_BITS, "0"),
    )
    assigned = reduce(DataFrame.unionByName, parts).withColumn("bits", bits)
    return assigned.withColumns(
        {"shard": F.expr("substring(bits, 1, depth)"), "oversized": F.col("shard_bytes") > max_bytes}
    ).drop("bits", "key_bits", "row_bits")


def shards(df: DataFrame, max_bytes: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its key, n_bytes, shard (its bits as a string), depth, shard_bytes, shard_rows and
    oversized."""
    if max_bytes < 1:
        raise ValueError("max_bytes must be at least 1")
    narrow = df.select(df[key_col].alias("key"), df[text_col].alias("text"))
    rows = keep(_with_bits(narrow, "key", "text").drop("text"), "sharding")
    return _assign(rows, max_bytes).withColumnRenamed("key", key_col)


def write_shards(df: DataFrame, path: str, max_bytes: int, key_col: str = "doc_id", text_col: str = "text") -> None:
    """Write df as Parquet below `path`, one folder shard=<bits> per shard and one file in each."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names))
    rows = keep(_with_bits(df.toDF(*names), at[key_col], at[text_col]), "sharding")
    dealt = _assign(rows, max_bytes).select(F.concat(F.lit("s"), "shard").alias("shard"), *names)
    renamed = dealt.toDF("shard_of_row", *df.columns)
    renamed.repartition("shard_of_row").write.partitionBy("shard_of_row").parquet(path)
