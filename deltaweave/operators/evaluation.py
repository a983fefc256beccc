"""Scoring changes, calibration, controls and comparisons of runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from .alignment import similarity
from .dealing import dealt, merged
from .similar import scored, similar_texts

# The bands of confidence.
BANDS = ((0.0, 0.5), (0.5, 0.75), (0.75, 0.9), (0.9, 1.0))


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1 to four places; nothing to find or nothing found counts as one."""
    p = F.when(tp + fp == 0, 1.0).otherwise(tp / F.nullif(tp + fp, F.lit(0)))
    r = F.when(tp + fn == 0, 1.0).otherwise(tp / F.nullif(tp + fn, F.lit(0)))
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))
    return [F.round(c, 4).alias(n) for c, n in ((p, "precision"), (r, "recall"), (f, "f1"))]


def calibration(scored: DataFrame) -> DataFrame:
    """band, n, n_correct, precision of scored(confidence, correct); a band without rows has null."""
    band = F.when(F.col("confidence") < 0.5, 0).when(F.col("confidence") < 0.75, 1).when(F.col("confidence") < 0.9, 2).otherwise(3)
    counts = scored.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct")).alias("n_correct"))
    every = scored.sparkSession.range(len(BANDS)).select(F.col("id").cast("int").alias("band"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return F.broadcast(every).join(counts, "band", "left").select("band", zero("n").alias("n"), zero("n_correct").alias("n_correct"), F.round(F.col("n_correct") / F.col("n"), 4).alias("precision"))


def _fresh(d: DataFrame, columns: list[str]) -> DataFrame:
    """These columns as new ones, so that two tables made from one can be grouped together."""
    return d.select(*[F.col(c).alias(c) for c in columns])


def greedy_match(predictions: DataFrame, truth: DataFrame, s: Settings = DEFAULT, by: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """by, pred, truth, same_zone for predictions matched to labelled changes.

    Both have the columns ``by``, ord, kind, sheet, zone, description. Predictions go
    in order; each takes an unused label of its kind and sheet: the most similar of
    its zone (first of equals), else the most similar of all (last of equals) if that
    reaches the floor. What one takes the next cannot, so it is a fold, over the pairs
    of one kind and sheet that share a zone or reach the floor.
    """
    group = [*by, "kind", "sheet"]
    side = lambda d, n: d.select(*group, F.col("ord").alias(n), F.col("zone").alias(f"zone_{n}"), F.coalesce("description", F.lit("")).alias(f"text_{n}"))
    p, t = side(predictions, "a"), side(truth, "b")
    same = F.col("zone_a").eqNullSafe(F.col("zone_b"))
    here = merged(p.alias("p")).join(t.alias("t"), [F.col(f"p.{c}") == F.col(f"t.{c}") for c in group] + [same]).select(*[f"p.{c}" for c in group], "a", "b", "text_a", "text_b")
    texts = lambda d, n: d.select(*group, F.col(f"text_{n}").alias("text"))
    # Both sides may come from one table; new names keep their columns apart.
    near = similar_texts(_fresh(texts(p, "a"), [*group, "text"]), _fresh(texts(t, "b"), [*group, "text"]), group, s.match_floor)
    far = merged(merged(near).join(p, [*group, "text_a"])).join(t, [*group, "text_b"]).where(~same)
    edges = scored(here).select(*group, "a", "b", "score", F.lit(True).alias("same_zone")).unionByName(far.select(*group, "a", "b", "score", F.lit(False).alias("same_zone")))
    types = dict(predictions.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], "pred int", "truth int", "same_zone boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come group by group, each in the order of choice; what is kept are the group's used numbers."""
        last, used_a, used_b = None, set(), set()
        for batch in batches:
            take = []
            keys = zip(*(batch[c].to_pylist() for c in group), strict=True)
            for i, (key, x, y) in enumerate(zip(keys, batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)):
                if key != last:
                    last, used_a, used_b = key, set(), set()
                if x not in used_a and y not in used_b:
                    used_a.add(x)
                    used_b.add(y)
                    take.append(i)
            some = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[some[c] for c in by], some["a"].cast(pa.int32()), some["b"].cast(pa.int32()), some["same_zone"]], [*by, "pred", "truth", "same_zone"])

    # Of one zone the first of equals is taken, of several the last.
    order = [*group, "a", F.desc("same_zone"), F.desc("score"), F.when(F.col("same_zone"), F.col("b")).otherwise(-F.col("b"))]
    return dealt(edges, *group).sortWithinPartitions(*order).mapInArrow(run, schema)


VISUAL = "unclassified_visual_change"


@dataclass
class PairScores:
    """card: one row a pair; by_kind: its counts by kind; real: predictions that count, each with whether it was matched."""

    card: DataFrame
    by_kind: DataFrame
    real: DataFrame


def score_pairs(predictions: DataFrame, truth: DataFrame, s: Settings = DEFAULT) -> PairScores:
    """Scores of predictions(pair_id, ord, kind, sheet, zone, description, semantic_null, confidence) against truth(..., is_cascade).

    Labels that are semantic nulls are matched first, and the predictions they take
    are left out of the real changes, like those that flag themselves as null and
    visual changes, which no label can match. Recall of primary and cascaded labels
    and the flag's own precision are matchings of their own: scopes of one fold.
    Kinds never compete for a label, so their counts come from the real matching.
    """
    flag = F.coalesce(F.col("semantic_null"), F.lit(False))
    labels = truth.withColumn("_null", flag)
    # Both are read several times over: scopes are rows, not runs.
    nulls, real_labels = labels.where("_null"), labels.where("NOT _null")
    claimed = greedy_match(predictions, nulls, s).select("pair_id", F.col("pred").alias("ord"))
    counted = predictions.where(~flag & (F.col("kind") != VISUAL)).join(claimed, ["pair_id", "ord"], "left_anti")
    scoped = lambda d, names: d.withColumn("scope", F.explode(F.array(*names)))
    keep = ["pair_id", "scope", "ord", "kind", "sheet", "zone", "description"]
    asked = scoped(predictions.where(flag), [F.lit("flagged")]).select(keep).unionByName(scoped(counted, [F.lit(n) for n in ("real", "primary", "cascade")]).select(keep))
    part = F.when(F.coalesce(F.col("is_cascade"), F.lit(False)), "cascade").otherwise("primary")
    wanted = scoped(nulls, [F.lit("flagged")]).select(keep).unionByName(scoped(real_labels, [F.lit("real"), part]).select(keep))
    matched = greedy_match(asked, wanted, s, ("pair_id", "scope"))

    count = lambda d, n: d.groupBy("pair_id").pivot("scope", ["flagged", "real", "primary", "cascade"]).agg(F.count(F.lit(1))).select("pair_id", *[F.col(c).alias(f"{n}_{c}") for c in ("flagged", "real", "primary", "cascade")])
    flat = lambda d, **aggregates: d.groupBy("pair_id").agg(*[v.alias(k) for k, v in aggregates.items()])
    pairs = predictions.select("pair_id").unionByName(truth.select("pair_id")).distinct()
    for d in (
        count(matched, "hit"), count(asked, "p"), count(wanted, "t"), flat(claimed, n_claimed=F.count(F.lit(1))),
        flat(predictions, n_pred=F.count(F.lit(1)), n_visual=F.count_if(F.col("kind") == VISUAL)),
    ):
        pairs = pairs.join(d, "pair_id", "left")
    pairs = pairs.na.fill(0)
    c = F.col
    rates = lambda scope, prefix: [
        x.alias(prefix + n) for n, x in zip(("precision", "recall", "f1"), precision_recall(c(f"hit_{scope}"), c(f"p_{scope}") - c(f"hit_{scope}"), c(f"t_{scope}") - c(f"hit_{scope}")), strict=True)
    ]
    share = lambda scope: F.when(c(f"t_{scope}") == 0, 1.0).otherwise(F.round(c(f"hit_{scope}") / F.nullif(c(f"t_{scope}"), F.lit(0)), 4)).alias(f"{scope}_recall")
    card = pairs.select(
        "pair_id", c("hit_real").alias("tp"), (c("p_real") - c("hit_real")).alias("fp"), (c("t_real") - c("hit_real")).alias("fn"), *rates("real", ""), share("primary"), share("cascade"),
        F.round(c("n_claimed") / F.nullif(c("t_flagged"), F.lit(0)), 4).alias("null_emission_rate"), *rates("flagged", "null_"),
        c("t_real").alias("n_truth"), c("t_flagged").alias("n_null"), "n_pred", "n_visual",
    )
    hits = matched.where("scope = 'real'").select("pair_id", F.col("pred").alias("ord"), F.lit(True).alias("correct"))
    real = counted.join(hits, ["pair_id", "ord"], "left").na.fill({"correct": False})
    return PairScores(card, pair_scores(real.where("correct"), real, real_labels, ["pair_id", "kind"]), real)


def exact_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """The exact half of the plain matcher: the n-th element of a content meets the n-th on the other side."""
    numbered = lambda d: d.withColumn("n", F.row_number().over(Window.partitionBy("pair_id", "type", "content").orderBy("ord")))
    left, right = numbered(a).withColumnRenamed("ord", "ord_a"), numbered(b).withColumnRenamed("ord", "ord_b")
    return left.join(right, ["pair_id", "type", "content", "n"]).select("pair_id", "type", "ord_a", "ord_b")


NAIVE = "pair_id long, type string, status string, ord_a int, ord_b int, score double"

# The plain matcher's own floor of similarity and least move.
NAIVE_FLOOR, NAIVE_MOVE = 55.0, 0.04


def naive_match(a: DataFrame, b: DataFrame, floor: float = NAIVE_FLOOR, move: float = NAIVE_MOVE) -> DataFrame:
    """NAIVE of two sides (pair_id, type, ord, content, x, y): unchanged, moved, modified, removed, added.

    Equal contents meet as in exact_match; the rest of a type pair off from the most
    similar down while they reach the floor (equals in the order of a, then of b's
    contents). Only the pairs of those leftovers that reach the floor are folded in
    Python. Null contents are empty.
    """
    fill = lambda d: d.withColumn("content", F.coalesce("content", F.lit("")))
    a, b = fill(a), fill(b)
    met = exact_match(a, b)
    at = lambda d, n: d.select("pair_id", "type", F.col("ord").alias(f"ord_{n}"), F.col("x").alias(f"x_{n}"), F.col("y").alias(f"y_{n}"))
    placed = met.join(at(a, "a"), ["pair_id", "type", "ord_a"]).join(at(b, "b"), ["pair_id", "type", "ord_b"])
    far = F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")) > move
    exact = placed.select("pair_id", "type", F.when(far, "moved").otherwise("unchanged").alias("status"), F.col("ord_a").cast("int"), F.col("ord_b").cast("int"), F.lit(100.0).alias("score"))
    first = F.min("ord").over(Window.partitionBy("pair_id", "type", "content"))
    left = lambda d, n: d.withColumn("first", first).join(met.select("pair_id", "type", F.col(f"ord_{n}").alias("ord")), ["pair_id", "type", "ord"], "left_anti")

    group = ["pair_id", "type"]
    # Both sides may come from one table; new names keep their columns apart.
    p = _fresh(left(a, "a"), [*group, "ord", "content"]).select(*group, F.col("ord").alias("ord_a"), F.col("content").alias("text_a"))
    q = _fresh(left(b, "b"), [*group, "ord", "content", "first"]).select(*group, F.col("ord").alias("ord_b"), F.col("content").alias("text_b"), "first")
    near = similar_texts(p.select(*group, F.col("text_a").alias("text")), q.select(*group, F.col("text_b").alias("text")), group, floor)
    edges = merged(merged(near).join(p, [*group, "text_a"])).join(q, [*group, "text_b"]).select(*group, "ord_a", "ord_b", "first", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come group by group, the most similar first; what is kept are the group's used numbers."""
        last, used_a, used_b = None, set(), set()
        for batch in batches:
            take = []
            keys = zip(*(batch[c].to_pylist() for c in group), strict=True)
            for i, (key, x, y) in enumerate(zip(keys, batch["ord_a"].to_pylist(), batch["ord_b"].to_pylist(), strict=True)):
                if key != last:
                    last, used_a, used_b = key, set(), set()
                if x not in used_a and y not in used_b:
                    used_a.add(x)
                    used_b.add(y)
                    take.append(i)
            some = batch.take(pa.array(take, pa.int64()))
            status = pa.array(["modified"] * len(take), pa.string())
            yield pa.RecordBatch.from_arrays([*[some[c] for c in group], status, some["ord_a"].cast(pa.int32()), some["ord_b"].cast(pa.int32()), some["score"]], [c.split()[0] for c in NAIVE.split(", ")])

    modified = dealt(edges, *group).sortWithinPartitions(*group, F.desc("score"), "ord_a", "first", "ord_b").mapInArrow(run, NAIVE)
    rest = lambda d, n, status: d.join(modified, [*group, f"ord_{n}"], "left_anti").select(
        *group, F.lit(status).alias("status"), *[(F.col(c) if c == f"ord_{n}" else F.lit(None)).cast("int").alias(c) for c in ("ord_a", "ord_b")], F.lit(None).cast("double").alias("score")
    )
    return exact.unionByName(modified).unionByName(rest(p, "a", "removed")).unionByName(rest(q, "b", "added"))


def pair_scores(matched: DataFrame, predictions: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1; the three tables share the columns ``by``."""
    count = lambda d, n: d.groupBy(*by).agg(F.count(F.lit(1)).alias(n))
    all_ = count(predictions, "p").join(count(truth, "t"), by, "full_outer").join(count(matched, "tp"), by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = all_.select(*by, zero("tp").alias("tp"), (zero("p") - zero("tp")).alias("fp"), (zero("t") - zero("tp")).alias("fn"))
    return counts.select(*by, "tp", "fp", "fn", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def micro_macro(scores: DataFrame, by: list[str]) -> DataFrame:
    """Sums of tp, fp, fn over pairs with their scores, and the mean recall."""
    sums = scores.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg("recall"), 4).alias("macro_recall"))
    return sums.select(*by, "tp", "fp", "fn", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")), "macro_recall")


def repeated_runs(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation (0 for one run)."""
    return runs.groupBy(*by).agg(F.count(value).alias("n_runs"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("stdev"))


def run_differences(runs: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Each run beside the one before it on the same dataset."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return runs.withColumn("previous", before).withColumn("change", F.round(F.col(value) - F.col("previous"), 6))


def scorecard(runs: DataFrame, by: list[str], order: str, metrics: list[str]) -> DataFrame:
    """by, run, metric, value, previous, change: the last run of each dataset beside the one before it, a row for each metric; null metrics stay."""
    within = Window.partitionBy(*by).orderBy(order)
    value = lambda c, last: F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), last.cast("double").alias("previous"))
    before = [value(c, F.lag(c).over(within)) for c in metrics]
    marked = runs.select(*by, F.col(order).alias("run"), F.array(*before).alias("m"), F.lead(order).over(within).isNull().alias("last"))
    told = marked.where("last").select(*by, "run", F.explode("m").alias("x")).select(*by, "run", "x.*")
    return told.withColumn("change", F.round(F.col("value") - F.col("previous"), 6))


def answer_scores(items: DataFrame, by: list[str]) -> DataFrame:
    """items(by, should_refuse, refused, n_citations, n_supported, correct): correct is null where no verdict was read."""
    answered = ~F.col("refused")
    full = answered & (F.col("n_citations") > 0) & (F.col("n_supported") == F.col("n_citations"))
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("should_refuse") == F.col("refused")).cast("double")), 4).alias("refusal_accuracy"),
        share(F.count_if(full), F.count_if(answered)).alias("fully_supported"),
        share(F.sum(F.when(answered, F.col("n_supported"))), F.sum(F.when(answered, F.col("n_citations")))).alias("support_rate"),
        share(F.count_if(F.col("correct")), F.count("correct")).alias("correctness"),
    )


def set_recall(wanted: DataFrame, found: DataFrame, by: list[str], value: str) -> DataFrame:
    """Share of the distinct wanted values that were found; one where none is wanted is impossible, so such groups do not occur."""
    w = wanted.select(*by, value).distinct()
    hit = w.join(found.select(*by, value).distinct().withColumn("_hit", F.lit(1)), [*by, value], "left")
    return hit.groupBy(*by).agg(F.count(F.lit(1)).alias("n_wanted"), F.count("_hit").alias("n_found"), F.round(F.count("_hit") / F.count(F.lit(1)), 4).alias("recall"))


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """missing, extra: how many rows of a are not in b, and of b not in a, repeats included."""
    one = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    return one(a.exceptAll(b), "missing").join(one(b.exceptAll(a), "extra"), how="cross")


def last_emission(emitted: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """The values of each key's last row."""
    return emitted.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("v"), F.count(F.lit(1)).alias("n_emitted")).select(*key, "v.*", "n_emitted")


def net_changes(emitted: DataFrame, reference: DataFrame) -> DataFrame:
    """Labels of a pair from what its edits emitted(pair_id, kind, id_a, id_b, ord, tags) and the reference difference(..., zone_a, zone_b, field_changes).

    Edits can undo each other, so only changes of the reference stay. Each takes the
    tags of its last emission (null if none) and the reference's zones; a
    modification also takes the reference's field changes, another kind those emitted.
    """
    key = ["pair_id", "kind", "id_a", "id_b"]
    tags = [c for c in emitted.columns if c not in (*key, "ord", "zone_a", "zone_b", "field_changes")]
    last = emitted.groupBy(*key).agg(F.max_by(F.struct(*tags, "field_changes"), "ord").alias("_last"))
    e, r = last.alias("e"), reference.alias("r")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}"))
    fields = F.when((F.col("r.kind") == "modify") | F.col("e._last").isNull(), F.col("r.field_changes")).otherwise(F.col("e._last.field_changes"))
    return r.join(e, same, "left").select(*[F.col(f"r.{k}") for k in key], "r.zone_a", "r.zone_b", fields.alias("field_changes"), *[F.col(f"e._last.{t}") for t in tags])


def partial_ratio(a: str, b: str) -> float:
    """Best similarity (0 to 100) of the shorter text with any window of its length in the longer one.

    Windows are tried by the most that their characters, in any order, could reach, until none can be better.
    """
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long_ else 0.0
    size, need = len(short), Counter(short)
    have: Counter[str] = Counter()
    common, tried = 0, []
    for i in range(1 - size, len(long_)):
        if i + size <= len(long_):
            have[x := long_[i + size - 1]] += 1
            common += have[x] <= need[x]
        if i > 0:
            common -= have[x := long_[i - 1]] <= need[x]
            have[x] -= 1
        start = max(0, i)
        tried.append((-2 * common / (size + min(len(long_), i + size) - start), start, i + size))
    best = 0.0
    for bound, start, end in sorted(tried):
        if -bound <= best:
            break
        best = max(best, similarity(short, long_[start:end]))
    return 100 * best


def content_supported(pairs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds ratio and supported to pairs(sentence, content)."""

    @F.pandas_udf("double")
    def ratio(sentence: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([partial_ratio((x or "").lower(), (y or "").lower()) for x, y in zip(sentence, content, strict=True)])

    return pairs.withColumn("ratio", ratio("sentence", "content")).withColumn("supported", F.col("ratio") >= s.support_floor)


def found_rows(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of truth(pair_id, sheet, zone, kind) that a primary change of their kind, or a visual change, in their zone finds."""
    hit = found.where("NOT is_cascade OR kind = 'unclassified_visual_change'").select("pair_id", "sheet", "zone", F.col("kind").alias("_kind")).distinct()
    joined = truth.join(hit, ["pair_id", "sheet", "zone"])
    keep = joined.where((F.col("_kind") == F.col("kind")) | (F.col("_kind") == "unclassified_visual_change"))
    return keep.drop("_kind").distinct()


def raster_recall(truth: DataFrame, off: DataFrame, on: DataFrame) -> DataFrame:
    """n, recall_off, recall_on, lift: what the raster layer adds."""
    marked = lambda d, n: found_rows(truth, d).groupBy("row_id").agg(F.lit(1).alias(n))
    both = truth.join(marked(off, "off"), "row_id", "left").join(marked(on, "on"), "row_id", "left")
    share = lambda c: F.round(F.count(c) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4)
    return both.agg(F.count(F.lit(1)).alias("n"), share("off").alias("recall_off"), share("on").alias("recall_on"), F.round((F.count("on") - F.count("off")) / F.count(F.lit(1)), 4).alias("lift"))


def residue_precision(visual: DataFrame, truth: DataFrame) -> DataFrame:
    """n_visual, n_hits, precision: visual changes(pair_id, zone_a, zone_b) in a zone of a label that is no semantic null."""
    zones = truth.where("NOT semantic_null").select("pair_id", F.coalesce("zone_b", "zone_a").alias("zone")).distinct().groupBy("pair_id").agg(F.collect_set("zone").alias("_zones"))
    hit = F.coalesce(F.array_contains("_zones", F.col("zone_a")), F.lit(False)) | F.coalesce(F.array_contains("_zones", F.col("zone_b")), F.lit(False))
    counts = visual.join(zones, "pair_id", "left").agg(F.count(F.lit(1)).alias("n_visual"), F.count_if(hit).alias("n_hits"))
    return counts.withColumn("precision", F.round(F.col("n_hits") / F.nullif(F.col("n_visual"), F.lit(0)), 4))


def canary_recall(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """pair_id, n_real, n_hit, recall: how many labelled changes a plain difference of the sides' texts would show.

    a and b are (pair_id, id, text), truth is (pair_id, did, id_a, id_b,
    semantic_null); null labels do not count, and a pair without others has one.
    """
    text = lambda d: d.where("text <> ''").select("pair_id", "text").distinct()
    # A text of one side alone: seen on one of the two.
    only = text(a).withColumn("side", F.lit(1)).unionByName(text(b).withColumn("side", F.lit(2))).groupBy("pair_id", "text").agg(F.sum("side").alias("n")).where("n < 3")
    shown = lambda d, n: d.join(only, ["pair_id", "text"], "left_semi").select("pair_id", F.col("id").alias(f"id_{n}"), F.lit(1).alias(f"in_{n}")).distinct()
    real = truth.withColumn("_real", ~F.coalesce(F.col("semantic_null"), F.lit(False)))
    marked = real.join(shown(a, "a"), ["pair_id", "id_a"], "left").join(shown(b, "b"), ["pair_id", "id_b"], "left")
    hit = F.col("_real") & (F.col("in_a").isNotNull() | F.col("in_b").isNotNull())
    counts = marked.groupBy("pair_id").agg(F.count_if("_real").alias("n_real"), F.count_if(hit).alias("n_hit"))
    return counts.withColumn("recall", F.when(F.col("n_real") == 0, 1.0).otherwise(F.round(F.col("n_hit") / F.nullif(F.col("n_real"), F.lit(0)), 4)))


def null_controls(deltas: DataFrame, pairs: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """kind of pair, pairs, changes, hard false positives (changes not flagged null) and the share flagged; and n_regions, if regions(pair_id) of rasters are given."""
    counts = deltas.groupBy("pair_id").agg(F.count(F.lit(1)).alias("d"), F.count_if(~F.col("semantic_null")).alias("h"))
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long")
    all_ = pairs.join(counts, "pair_id", "left").groupBy("pair_kind").agg(F.count(F.lit(1)).alias("n_pairs"), zero("d").alias("n_deltas"), zero("h").alias("hard"))
    rated = all_.withColumn("null_rate", F.round((F.col("n_deltas") - F.col("hard")) / F.nullif(F.col("n_deltas"), F.lit(0)), 4))
    if regions is None:
        return rated
    seen = pairs.join(regions.groupBy("pair_id").agg(F.count(F.lit(1)).alias("r")), "pair_id").groupBy("pair_kind").agg(F.sum("r").alias("n_regions"))
    return rated.join(seen, "pair_kind", "left").na.fill(0, ["n_regions"])


def direct_prompt(elements: DataFrame) -> DataFrame:
    """pair_id, side, prompt: a side as zone-tagged lines for a direct-model baseline; geometry and blanks are left out."""
    e = elements.where((F.col("type") != "geometry") & (F.trim("content") != ""))
    line = F.concat(F.lit("["), F.col("zone"), F.lit("] "), F.col("content"))
    return e.groupBy("pair_id", "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("prompt"))


def direct_changes(replies: DataFrame) -> DataFrame:
    """pair_id, place, kind, sheet, zone, description of replies(pair_id, reply).

    The outermost bracketed array counts; items that are no objects, or have no kind, are skipped.
    """
    body = F.regexp_extract("reply", r"(?s)(\[.*\])", 1)
    items = replies.select("pair_id", F.posexplode(F.from_json(body, "array<string>")).alias("place", "item"))
    parsed = items.withColumn("o", F.from_json("item", "kind string, sheet int, zone string, description string"))
    return parsed.where("o.kind IS NOT NULL").select("pair_id", "place", "o.kind", "o.sheet", "o.zone", "o.description")


def chat_runs(questions: DataFrame, precheck: DataFrame) -> DataFrame:
    """question_id, pair_id, asked: questions to refused pairs count as refused and are not asked."""
    return questions.join(precheck.select("pair_id", "is_pair"), "pair_id").select("question_id", "pair_id", F.col("is_pair").alias("asked"))
