"""Is it the same document? Signals, tag overlap and the decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.tags import TAG_TYPES
from .dealing import dealt


def counted(elements: DataFrame) -> DataFrame:
    """pair_id, side, type, content, field, n, seen: what signals and overlap both need, in one aggregation of the elements."""
    return elements.groupBy("pair_id", "side", "type", "content", "field").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("seen"))


def signals(counts: DataFrame) -> DataFrame:
    """pair_id, drawing_a, drawing_b, equipment_a, equipment_b from counted elements.

    The drawing number is the first title field of that kind, the equipment the most
    frequent tag, of equal ones the first seen.
    """
    on = lambda side, test: (F.col("side") == side) & test
    number = (F.col("type") == "title_field") & (F.col("field") == "drawno")
    equipment = F.col("type") == "equipment_tag"
    first = lambda side: F.min_by("content", F.when(on(side, number), F.col("seen"))).alias(f"drawing_{side.lower()}")
    most = lambda side: F.max_by("content", F.when(on(side, equipment), F.struct("n", -F.col("seen")))).alias(f"equipment_{side.lower()}")
    return counts.groupBy("pair_id").agg(*[make(side) for make in (first, most) for side in "AB"])


def tag_overlap(counts: DataFrame) -> DataFrame:
    """pair_id, overlap: Jaccard similarity of the distinct tags; null if a side has none.

    Counted by tag instead of comparing two sets, so no side is gathered.
    """
    tags = counts.where(F.col("type").isin(*TAG_TYPES)).groupBy("pair_id", "content").agg(F.max((F.col("side") == "A").cast("int")).alias("a"), F.max((F.col("side") == "B").cast("int")).alias("b"))
    return tags.groupBy("pair_id").agg(F.when((F.sum("a") > 0) & (F.sum("b") > 0), F.sum(F.col("a") * F.col("b")) / F.count(F.lit(1))).alias("overlap"))


#: Members of a class that stand in one row on average, when its pairs are written out.
BLOCK = 256


def similar_sets(items: DataFrame, id_: str, item: str, least: float) -> DataFrame:
    """a, b, shared, jaccard of sets (distinct rows id_, item) with a Jaccard similarity of at least ``least``; a < b.

    Equal sets are one for all that follows. Of a set, only its size and the items that
    another set has too decide what it pairs, so sets that agree in these are one class,
    and classes meet instead of sets; texts that have a line of furniture and else lines
    of their own are few classes, though all of them are pairs. Members are paired at
    the end, by blocks of a class, in rows that no shuffle sees.

    Exact by prefixes: two such sets share one of the n - ceil(least * n) + 1 rarest
    items of either, so only those meet in a join, and furniture that stands in many
    sets pairs them only if they have little else. Where the prefixes are all items of
    both sets, the join has counted the shared ones; only other pairs meet their sets again.
    """
    each = items.where(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("_id")).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    equal = each.groupBy("_all").agg(F.min("_id").alias("_e"), F.count(F.lit(1)).alias("_k"))
    lines = equal.select("_e", "_k", F.size("_all").cast("long").alias("_n"), F.explode("_all").alias("_i"))
    counts = lines.groupBy("_i").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    sets = lines.join(counts, "_i").groupBy("_e", "_k", "_n").agg(F.array_sort(F.collect_list(F.struct("_df", "_i"))).alias("_items"))
    needed = F.ceil(F.round(F.col("_n") * least, 9))
    sets = sets.where(F.size("_items") >= needed)
    classes = sets.groupBy("_n", "_items").agg(F.min("_e").alias("_c"), F.sum("_k").alias("_k"), F.count(F.lit(1)).alias("_es")).withColumn("_m", F.size("_items").cast("long"))
    # Items of one set alone are the rarest of all; they take up places of the prefix.
    classes = classes.withColumn("_p", F.least("_m", F.greatest(F.lit(0), F.col("_m") - needed + 1)))
    prefix = classes.select("_c", "_n", "_m", "_p", F.explode(F.slice("_items", F.lit(1), F.col("_p").cast("int"))).alias("_x"))
    side = lambda s: prefix.select(F.col("_x._i").alias("_i"), F.col("_c").alias(s), F.col("_n").alias(f"_n{s}"), F.col("_m").alias(f"_m{s}"), (F.col("_m") - F.col("_p")).alias(f"_s{s}"))
    enough = lambda shared, sizes: shared / (sizes - shared) >= least
    most, sizes = F.least("_ma", "_mb"), F.col("_na") + F.col("_nb")
    met = side("a").join(side("b"), "_i").where((F.col("a") < F.col("b")) & enough(most, sizes))
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_c"), F.max(sizes).alias("_sizes"), F.max(most).alias("_most"), F.max(F.col("_sa") + F.col("_sb")).alias("_left"))
    pairs = pairs.where(enough(F.least(F.col("_c") + F.col("_left"), "_most"), F.col("_sizes")))  # for both branches, so that they share the shuffle
    whole = pairs.where(F.col("_left") == 0).select("a", "b", F.col("_c").alias("shared"), "_sizes")
    open_ = pairs.where("_left > 0").select("a", "b", "_sizes")
    of = lambda s: classes.select(F.col("_c").alias(s), F.transform("_items", lambda x: x["_i"]).alias(f"_i{s}"))
    counted_ = open_.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.size(F.array_intersect("_ia", "_ib")).cast("long").alias("shared"), "_sizes")
    one = lambda df, c, shared: df.select(F.col(c).alias("a"), F.col(c).alias("b"), shared.alias("shared"), (2 * F.col("_n")).alias("_sizes"))
    met_ = whole.unionByName(counted_).unionByName(one(classes.where("_es > 1"), "_c", F.col("_m"))).where(enough(F.col("shared"), F.col("_sizes")))
    # The sets of each class, and of those that are equal.
    copies = equal.where("_k > 1")
    members = equal.where("_k = 1").select("_e", F.col("_e").alias("_id")).unionByName(each.join(copies, "_all").select("_e", "_id"))
    of_class = sets.select("_e", "_n", "_items").join(classes.select("_n", "_items", "_c", "_k"), ["_n", "_items"]).select("_e", "_c", "_k")
    unlike = _written(met_, members.join(of_class, "_e").select("_c", "_k", "_e", "_id"), apart=True)
    alike = _written(one(copies.withColumn("_n", F.size("_all").cast("long")), "_e", F.col("_n")), each.join(copies, "_all").select(F.col("_e").alias("_c"), "_k", "_e", "_id"), apart=False)
    return unlike.unionByName(alike).select("a", "b", "shared", (F.col("shared") / (F.col("_sizes") - F.col("shared"))).alias("jaccard"))


def _written(pairs: DataFrame, members: DataFrame, apart: bool) -> DataFrame:
    """Pairs (a, b, shared, _sizes) of classes as pairs of their members (_c, _k: how many, _e, _id); apart: only of members with different _e."""
    block = F.pmod(F.xxhash64("_id"), F.ceil(F.col("_k") / BLOCK))
    blocks = members.groupBy("_c", block.alias("_at")).agg(F.collect_list(F.struct("_id", "_e")).alias("_ids"))
    of = lambda s: blocks.select(F.col("_c").alias(s), F.col("_at").alias(f"_at{s}"), F.col("_ids").alias(f"_ids{s}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b").where("a < b OR _ata <= _atb")
    same = ((F.col("a") == F.col("b")) & (F.col("_ata") == F.col("_atb"))).alias("_same")
    # A few bytes may be many pairs, so they are dealt by number.
    rows = dealt(met, "a", "_ata", "b", "_atb").select(F.explode("_idsa").alias("_x"), "_idsb", same, "shared", "_sizes").select("_x", F.explode("_idsb").alias("_y"), "_same", "shared", "_sizes")
    rows = rows.where("NOT _same OR _x._id < _y._id")
    if apart:
        rows = rows.where("_x._e <> _y._e")
    return rows.select(F.least("_x._id", "_y._id").alias("a"), F.greatest("_x._id", "_y._id").alias("b"), "shared", "_sizes")


def decide(found: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds tier and is_pair to drawing_a/b, equipment_a/b, overlap.

    The first tier with a value on both sides decides; equal but empty values say nothing.
    """
    both = lambda c: F.col(f"{c}_a").isNotNull() & F.col(f"{c}_b").isNotNull() & ~((F.col(f"{c}_a") == "") & (F.col(f"{c}_b") == ""))
    tier = F.when(both("drawing"), "drawing_number").when(both("equipment"), "equipment").when(F.col("overlap").isNotNull(), "tag_overlap").otherwise("none")
    is_pair = (
        F.when(F.col("tier") == "drawing_number", F.col("drawing_a") == F.col("drawing_b"))
        .when(F.col("tier") == "equipment", F.col("equipment_a") == F.col("equipment_b"))
        .when(F.col("tier") == "tag_overlap", F.col("overlap") >= s.tag_overlap)
        .otherwise(True)
    )
    return found.withColumn("tier", tier).withColumn("is_pair", is_pair)


def precheck(elements: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row for each pair; elements(pair_id, side, ord, type, content, field)."""
    counts = counted(elements)
    return decide(signals(counts).join(tag_overlap(counts), "pair_id", "left"), s)
