"""Category tables: totals, the most frequent, the rare, the new ones, and projection on a known list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import ABSENT, REST, key_label, share
from ..sources.tables import literal_table
from .counting import category_counts, category_counts_of_two, known_category_counts

# How many tasks share the ranking of one feature's categories before the last step.
TOP_K_LANES = 64

# Up to this k, Spark lets every task keep its own best k before the shuffle.
TOP_K_IN_TASK = 1000

# So many equally frequent categories may reach the ranking besides the wanted ones; more are narrowed down by their keys.
TIES_RANKED = 100_000


def category_totals(counts: DataFrame) -> DataFrame:
    """feature, total_count, null_count, cardinality (the missing category counts as one)."""
    return counts.groupBy("feature").agg(
        F.sum("n").alias("total_count"),
        F.sum(F.when(F.col("kind") == ABSENT, F.col("n")).otherwise(0)).alias("null_count"),
        F.count("*").alias("cardinality"),
    )


def most_frequent(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent categories per feature with their position; ties go by key.

    Each task keeps its own best k before the shuffle. Their number still grows with the tasks, so
    they are narrowed down once more in lanes before one task per feature takes the last step: it
    gets at most k rows per lane. From k = 1001 on Spark keeps nothing back in the tasks: then candidates()
    selects by thresholds first, with a few jobs over counts, which had better be a written table.
    """
    if k > TOP_K_IN_TASK:
        counts = candidates(counts, k)

    def best(rows: DataFrame, *group: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.col("n").desc(), F.col("key").asc_nulls_first())
        return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)

    lanes = counts.withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(TOP_K_LANES)))
    return best(best(lanes, "feature", "lane").drop("lane", "position"), "feature")


def candidates(counts: DataFrame, k: int, ties: int = TIES_RANKED) -> DataFrame:
    """The k most frequent categories per feature and, at most, `ties` further ones that are as frequent as the last of them.

    A histogram of the counts (how many categories have n rows; a table of R rows has at most sqrt(2 R) different n) gives
    the count of the k-th category. Where more are as frequent as that than fit, they are narrowed down by longer and longer
    beginnings of their keys, each again by a histogram. One row per feature and step reaches the driver.
    """
    by_count = counts.groupBy("feature", "n").agg(F.count("*").alias("size"))
    found = _kth(by_count, F.col("n").desc(), "n", k).collect()
    # a feature with k categories or fewer has no threshold
    cuts = {r["feature"]: {"n": r["n"], "need": k - r["before"], "size": r["size"], "start": None, "whole": False} for r in found}
    thresholds = "feature string, cut bigint, start string, whole boolean"

    def limits(features: Sequence[str]) -> DataFrame:
        # one row per feature
        listed = [(x, *(cuts[x][c] for c in ("n", "start", "whole"))) for x in features]
        return F.broadcast(literal_table(counts.sparkSession, listed, thresholds))

    def open_features() -> list[str]:
        return [x for x, cut in cuts.items() if cut["size"] > cut["need"] + ties]

    while wide := open_features():
        # equal counts, and a key that begins like the k-th one, as far as that is known
        level = (
            counts.join(limits(wide), "feature")
            .filter((F.col("n") == F.col("cut")) & F.col("key").isNotNull())
            .filter(F.col("start").isNull() | F.startswith(F.col("key"), F.col("start")))
        )
        ends = level.groupBy("feature").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()
        # two characters beyond what all of them share
        lengths = {r["feature"]: _shared(r["first"], r["last"]) + 2 for r in ends}
        listed = literal_table(counts.sparkSession, lengths.items(), "feature string, length int")
        parts = (
            level.join(F.broadcast(listed), "feature")
            .groupBy("feature", F.expr("substring(key, 1, length)").alias("begin"))
            .agg(F.count("*").alias("size"))
        )
        wanted = literal_table(counts.sparkSession, [(x, cuts[x]["need"]) for x in wide], "feature string, need bigint")
        for r in _kth(parts.join(F.broadcast(wanted), "feature"), F.col("begin").asc(), "begin", F.col("need")).collect():
            cut = cuts[r["feature"]]
            whole = len(r["begin"]) < lengths[r["feature"]]
            cut.update(start=r["begin"], need=cut["need"] - r["before"], size=r["size"], whole=whole)
    if not cuts:
        return counts
    # a key is within the limit if it is below the k-th one's beginning or begins with it; a missing value comes first
    begins = F.when(F.col("whole"), F.col("key") == F.col("start")).otherwise(F.startswith(F.col("key"), F.col("start")))
    by_key = F.col("start").isNull() | F.col("key").isNull() | (F.col("key") < F.col("start")) | begins
    within = F.col("cut").isNull() | (F.col("n") > F.col("cut")) | ((F.col("n") == F.col("cut")) & by_key)
    return counts.join(limits(list(cuts)), "feature", "left").filter(within).drop("cut", "start", "whole")


def _kth(parts: DataFrame, order: Column, value: str, k: int | Column) -> DataFrame:
    """feature, value, size, before: the part that holds the k-th row when parts stand in this order, and the rows before it.

    parts has feature, value and size. A feature with fewer than k rows has no row.
    """
    so_far = F.sum("size").over(Window.partitionBy("feature").orderBy(order))
    k = F.lit(k) if isinstance(k, int) else k
    return (
        parts.withColumn("so_far", so_far)
        .filter((F.col("so_far") >= k) & (F.col("so_far") - F.col("size") < k))
        .select("feature", value, "size", (F.col("so_far") - F.col("size")).alias("before"))
    )


def _shared(first: str, last: str) -> int:
    """How many characters two texts have in common from the start."""
    return next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))


def rare_categories(
    counts: DataFrame, totals: DataFrame, threshold: float, listed: int | None = None
) -> DataFrame:
    """feature, kind, key, n, p of all categories with a share below threshold.

    With `listed`, only that many per feature, with their position, most frequent first.
    """
    rare = (
        # totals has one row per feature, so its size is bounded by the width of the schema
        counts.join(F.broadcast(totals.select("feature", "total_count")), "feature")
        .withColumn("p", share(F.col("n"), F.col("total_count")))
        .filter(F.col("p") < F.lit(threshold))
        .drop("total_count")
    )
    return rare if listed is None else most_frequent(rare, listed)


def category_bins(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """feature, bins: the entries in order of position, and one 'other' entry for the rows they leave out."""
    listed = entries.groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("position", "kind", "key", "n"))).alias("listed"),
        F.sum("n").alias("n_listed"),
    )
    rest = F.struct(
        F.lit(None).cast("int").alias("position"),
        F.lit(REST).alias("kind"),
        F.lit(None).cast("string").alias("key"),
        (F.col("total_count") - F.col("n_listed")).alias("n"),
    )
    every = F.when(F.col("total_count") > F.col("n_listed"), F.concat("listed", F.array(rest))).otherwise(
        F.col("listed")
    )
    # totals: one row per feature
    return listed.join(F.broadcast(totals), "feature").select(
        "feature",
        F.transform(
            every,
            lambda x: F.struct(
                x["kind"].alias("kind"),
                key_label(x["kind"], x["key"]).alias("key"),
                F.lit(None).cast("int").alias("ord"),
                x["n"].alias("n"),
                share(x["n"], F.col("total_count")).alias("p"),
            ),
        ).alias("bins"),
    )


def key_lists(known: DataFrame) -> dict[str, dict[str, list[str]]]:
    """The known keys (feature, kind, key) as {feature: {kind: keys}}: top_k per feature, as the settings say."""
    lists: dict[str, dict[str, list[str]]] = {}
    for row in known.collect():
        lists.setdefault(row["feature"], {}).setdefault(row["kind"], []).append(row["key"])
    return lists


def projected_counts(
    df: DataFrame, known: DataFrame, features: Sequence[str], lists: Mapping | None = None
) -> DataFrame:
    """Counts of df's categories on a known list (feature, kind, key), the rest summed as 'other'.

    lists: the same list as made by key_lists, to be tested in the scan. Without it the list is joined, after
    counting. A feature without known categories has only 'other'.
    Result: feature, kind, key, n, n_valued.
    """
    if lists is not None:
        return known_category_counts(df, {x: lists.get(x, {}) for x in features})
    return project(category_counts(df, features), known)


def project(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Category counts summed onto a known list by a join; a frequent category is one row here."""
    keys = known.filter(F.col("kind") != REST).withColumn("is_known", F.lit(True))
    is_known = F.col("k.is_known").isNotNull()
    return (
        counts.alias("c")
        .join(
            keys.alias("k"),
            (F.col("c.feature") == F.col("k.feature"))
            & (F.col("c.kind") == F.col("k.kind"))
            & F.col("c.key").eqNullSafe(F.col("k.key")),
            "left",
        )
        .select(
            "c.feature",
            F.when(is_known, F.col("c.kind")).otherwise(REST).alias("kind"),
            F.when(is_known, F.col("c.key")).alias("key"),
            "c.n",
            F.when(F.col("c.kind") == ABSENT, 0).otherwise(F.col("c.n")).alias("valued"),
        )
        .groupBy("feature", "kind", "key")
        .agg(F.sum("n").alias("n"), F.sum("valued").alias("n_valued"))
    )


def new_categories(
    reference: DataFrame, current: DataFrame, features: Sequence[str], listed: int | None = None
) -> DataFrame:
    """feature, category, n: all categories of current that reference never has.

    Both sides are counted together, which takes one shuffle of the categories and no join. With `listed`,
    only that many per feature, the most frequent ones.
    """
    unseen = (
        category_counts_of_two(reference, current, features)
        .filter("n_ref = 0 AND n_cur > 0")
        .withColumnRenamed("n_cur", "n")
    )
    wanted = unseen if listed is None else most_frequent(unseen, listed)
    return wanted.select("feature", key_label(F.col("kind"), F.col("key")).alias("category"), "n")


def known_keys(counts: DataFrame) -> DataFrame:
    """Category counts as a table to be stored: feature, kind, key, n with an empty key for the missing category, so that
    plain equality of the first three columns finds a category."""
    return counts.select("feature", "kind", F.coalesce("key", F.lit("")).alias("key"), "n")


def categories_not_in(known: DataFrame, current: DataFrame, features: Sequence[str], listed: int | None = None) -> DataFrame:
    """feature, category, n: all categories of current that a table of known_keys() lacks.

    Only current is counted. If known is a bucketed table, its side is read as it lies and the counts of current are
    shuffled to its buckets. `listed` as in new_categories.
    """
    counts = known_keys(category_counts(current, features))
    unseen = counts.join(known.select("feature", "kind", "key"), ["feature", "kind", "key"], "left_anti")
    wanted = unseen if listed is None else most_frequent(unseen, listed)
    return wanted.select("feature", key_label(F.col("kind"), F.col("key")).alias("category"), "n")


def new_category_share() -> Column:
    """Share of the current keys that the reference list lacks, over the keys of a paired table."""
    return F.coalesce(share(F.count_if(_is_new()), F.count_if(F.col("n_cur") > 0)), F.lit(0.0))


def new_category_row_share() -> Column:
    """The same by rows: share of the current rows that hold a new key."""
    rows = F.sum(F.when(_is_new(), F.col("n_cur")).otherwise(0))
    return F.coalesce(share(rows, F.sum("n_cur")), F.lit(0.0))


def _is_new() -> Column:
    return (F.col("n_cur") > 0) & (F.col("n_ref") == 0)
