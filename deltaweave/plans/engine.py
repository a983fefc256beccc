"""The whole comparison as one plan over many pairs of revisions."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import geometry as G
from ..functions import tags as T
from ..functions import text as X
from ..operators import alignment, bubbles, deltas, identity, raster, registration, rendering, retrieval, runs

PAGE = ["pair_id", "side", "sheet"]


@dataclass
class Comparison:
    """Tables of a run; pairs that were refused stay in ``precheck`` with the tier that refused them."""

    elements: DataFrame
    precheck: DataFrame
    transforms: DataFrame
    matches: DataFrame
    deltas: DataFrame

    def summary(self) -> DataFrame:
        return deltas.summary(self.deltas, ["pair_id"])

    def chunks(self) -> DataFrame:
        return retrieval.chunks(self.elements, self.deltas)

    def report(self) -> DataFrame:
        return rendering.markdown_report(deltas.report_order(self.deltas))

    def boxes(self) -> DataFrame:
        placed = self.deltas if "box" in self.deltas.columns else self.deltas.withColumn("box", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"))
        return rendering.boxes(placed, self.elements)

    def search(self, questions: DataFrame, aliases: DataFrame | None = None, s: Settings = DEFAULT) -> DataFrame:
        """Hits of questions(question_id, pair_id, question); those about refused pairs find none."""
        accepted = self.precheck.where("is_pair").select("pair_id")
        return retrieval.search(self.chunks().join(accepted, "pair_id", "left_semi"), questions, aliases, s)

    def stored(self, folder: str) -> Comparison:
        """The same tables written to a folder that all executors share, so that several outputs do not match anew."""
        return Comparison(**{f.name: written(getattr(self, f.name), f"{folder}/{f.name}") for f in fields(self)})


def written(table: DataFrame, path: str) -> DataFrame:
    """The table as Parquet: later plans start from the file, and lost executors cost no more than reading it again."""
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def text_elements(text_runs: DataFrame, confidence: Column | None = None) -> DataFrame:
    """Elements of runs(PAGE, run, text, x0, y0, x1, y1, anchor_x, anchor_y); type and zone come from the anchor."""
    c = T.classify(F.col("text"), F.col("anchor_x"), F.col("anchor_y"))
    box = G.box(*[F.col(k) for k in ("x0", "y0", "x1", "y1")])
    found = text_runs.withColumn("_c", c).withColumn("box", box).withColumn("content", X.strip(F.col("text")))
    return found.select(
        *PAGE, F.col("run").cast("int").alias("ord"), T.element_id(F.col("sheet"), F.col("_c.type"), F.col("content"), F.col("box")).alias("id"), F.col("_c.type").alias("type"), "content", "box",
        G.zone(F.col("anchor_x"), F.col("anchor_y")).alias("zone"), (confidence if confidence is not None else F.lit(1.0)).alias("confidence"), F.lit(None).cast("string").alias("geom_kind"),
        T.attributes(F.col("content"), F.col("_c.type")).alias("attrs"), T.title_field(F.col("content"))["field"].alias("field"),
    )


def geometry_elements(paths: DataFrame, width: Column, height: Column) -> DataFrame:
    """Elements of paths(PAGE, ord, items, x0, y0, x1, y1, start_x, start_y): the border of a sheet is none, boxes without area are.

    items are the path's codes. A line is placed by its start, anything else by its centre.
    """
    share = G.box(F.col("x0") / width, F.col("y0") / height, F.col("x1") / width, F.col("y1") / height)
    kinds = paths.withColumn("box", share).withColumn("_kind", G.path_kind(F.col("items"))).withColumn("_g", G.geometry_class(F.col("_kind"), F.col("box"))).where("_g IS NOT NULL")
    line = (F.col("_kind") == "line") & F.col("start_x").isNotNull()
    x, y = G.centre(F.col("box"))
    at = (F.when(line, F.col("start_x") / width).otherwise(x), F.when(line, F.col("start_y") / height).otherwise(y))
    attr = lambda key, num, text: F.struct(F.lit(key).alias("key"), num.cast("double").alias("num"), text.cast("string").alias("str"))
    none = F.lit(None)
    attrs = F.filter(F.array(attr("geom_kind", none, F.col("_kind")), attr("r_norm", F.col("_g.r_norm"), none)), lambda a: a["num"].isNotNull() | a["str"].isNotNull())
    return kinds.select(
        *PAGE, F.col("ord").cast("int").alias("ord"), T.element_id(F.col("sheet"), F.lit("geometry"), F.lit(""), F.col("box")).alias("id"), F.lit("geometry").alias("type"), F.lit("").alias("content"), "box",
        G.zone(*at).alias("zone"), F.lit(1.0).alias("confidence"), F.col("_kind").alias("geom_kind"), attrs.alias("attrs"), none.cast("string").alias("field"),
    )


def with_bubbles(texts: DataFrame, geometry: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Text elements with the unclassified tokens that are stacked in a circle put together as one instrument.

    The instrument takes the union of its tokens' boxes, and the zone and number of its function token.
    """
    x, y = G.centre(F.col("box"))
    tokens = texts.where("type = 'unknown'").select(*PAGE, "ord", F.col("content").alias("text"), x.alias("x"), y.alias("y"))
    circles = geometry.where("geom_kind = 'circle'").select(*PAGE, "ord", *[F.col("box")[k].alias(k) for k in ("x0", "y0", "x1", "y1")])
    stacked = bubbles.stack_bubbles(tokens, circles, s)
    used = stacked.select(*PAGE, "circle", "func", F.col("text").alias("_text"), F.explode("tokens").alias("ord"))
    parts = texts.join(used, [*PAGE, "ord"])
    edge = lambda f, k: f(F.col("box")[k])
    made = parts.groupBy(*PAGE, "func", "circle", "_text").agg(
        G.box(edge(F.min, "x0"), edge(F.min, "y0"), edge(F.max, "x1"), edge(F.max, "y1")).alias("box"), F.max(F.when(F.col("ord") == F.col("func"), F.col("zone"))).alias("zone")
    )
    tag = F.lit("instrument")
    bubbled = made.select(
        *PAGE, F.col("func").alias("ord"), T.element_id(F.col("sheet"), tag, F.col("_text"), F.col("box")).alias("id"), tag.alias("type"), F.col("_text").alias("content"), "box", "zone",
        F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("geom_kind"), T.attributes(F.col("_text"), tag).alias("attrs"), F.lit(None).cast("string").alias("field"),
    )
    return texts.join(used.select(*PAGE, "ord"), [*PAGE, "ord"], "left_anti").unionByName(bubbled)


def page_elements(texts: DataFrame, geometry: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Text and geometry of a page numbered together, text first, with bubbles put together."""
    both = with_bubbles(texts, geometry, s).withColumn("_g", F.lit(0)).unionByName(geometry.withColumn("_g", F.lit(1)))
    return both.withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy("_g", "ord")).cast("int")).drop("_g")


def held_out_elements(lines: DataFrame, width: Column, height: Column, prefix: str) -> DataFrame:
    """pair_id, side, sheet, eid, text, box, zone of lines(PAGE, text, x0, y0, x1, y1, in points).

    Names depend on text and corner (to a tenth of a point), not on a type, and zones on a line's centre.
    """
    text = X.strip(F.col("text"))
    # A name is made of numbers written with one decimal, negative zero as zero.
    tenth = lambda c: F.format_string("%.1f", F.bround(F.col(c), 1) + F.lit(0.0))
    name = F.concat(F.lit(prefix + ":"), F.substring(F.sha1(F.concat(F.col("text"), F.lit("|"), tenth("x0"), F.lit(","), tenth("y0"))), 1, 10))
    share = G.box(F.col("x0") / width, F.col("y0") / height, F.col("x1") / width, F.col("y1") / height)
    found = lines.withColumn("text", text).where("text <> ''").withColumn("box", share)
    return found.select(*PAGE, name.alias("eid"), "text", "box", G.zone(*G.centre(F.col("box"))).alias("zone"))


def from_spans(spans: DataFrame, width: Column, height: Column, s: Settings = DEFAULT, paths: DataFrame | None = None) -> DataFrame:
    """Elements of spans, and of drawn paths if there are any."""
    texts = text_elements(runs.run_text(runs.span_runs(spans, s), width, height, s))
    return texts if paths is None else page_elements(texts, geometry_elements(paths, width, height), s)


def compare(elements: DataFrame, s: Settings = DEFAULT) -> Comparison:
    """Compare both sides of every pair.

    elements: PAGE, ord (unique on its page), id, type, content, box, zone,
    confidence, geom_kind, attrs (array of key, num, str), field. All joins carry
    pair and sheet, and the only grouped Python is the assignment of a bucket.
    """
    checked = identity.precheck(elements, s)
    accepted = elements.join(checked.where("is_pair").select("pair_id"), "pair_id", "left_semi")
    x, y = G.centre(F.col("box"))
    placed = accepted.withColumn("x", x).withColumn("y", y)
    transforms = registration.similarity(registration.anchors(placed), s).drop("n_anchors")
    bucketed = alignment.with_bucket(placed)
    a, b = (bucketed.where(F.col("side") == side) for side in "AB")
    matches = alignment.match_elements(a, b, transforms, s)
    keep = ["id", "type", "content", "zone", "confidence", "x", "y", "attrs"]
    side = lambda d, n: d.select("pair_id", "sheet", F.col("ord").alias(f"ord_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in keep])
    joined = matches.join(side(a, "a"), ["pair_id", "sheet", "ord_a"], "left").join(side(b, "b"), ["pair_id", "sheet", "ord_b"], "left")
    return Comparison(elements, checked, transforms, matches, annotate(joined, s))


def run(spans: DataFrame, width: Column, height: Column, folder: str, paths: DataFrame | None = None, images: DataFrame | None = None, s: Settings = DEFAULT, otsu: bool = False) -> Comparison:
    """From extracted spans (and drawn paths, and page images) to every change of all pairs, each step written below a shared folder.

    Elements are read many times by a comparison, and changes by the join with
    images, so each is written once instead of being made anew for every use.
    """
    elements = written(from_spans(spans, width, height, s, paths), f"{folder}/input")
    found = compare(elements, s).stored(f"{folder}/symbolic")
    return found if images is None else with_images(found, images, s, otsu).stored(f"{folder}/visual")


def annotate(joined: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Changes of joined matches: kind, fields, confidence, cascades, severity, semantic nulls."""
    in_a, in_b = F.col("ord_a").isNotNull(), F.col("ord_b").isNotNull()
    # Attributes are few for each element, so their full outer join stays within the row.
    keys = F.array_union(F.transform(F.col("attrs_a"), lambda x: x["key"]), F.transform(F.col("attrs_b"), lambda x: x["key"]))
    at = lambda attrs, k: F.get(F.filter(F.col(attrs), lambda x: x["key"] == k), F.lit(0))
    pairs = F.transform(F.array_sort(keys), lambda k: F.struct(k.alias("key"), at("attrs_a", k).alias("old"), at("attrs_b", k).alias("new")))
    changed = F.filter(pairs, lambda p: deltas.differs(p["old"]["num"], p["new"]["num"], s) | ~p["old"]["str"].eqNullSafe(p["new"]["str"]))
    number = lambda n: F.when(n == F.floor(n), n.cast("bigint").cast("string")).otherwise(n.cast("string"))
    shown = lambda v: F.coalesce(v["str"], number(v["num"]))
    change = lambda key, old, new, old_num, new_num: F.struct(key.alias("key"), old.alias("old"), new.alias("new"), old_num.alias("old_num"), new_num.alias("new_num"))
    none = F.lit(None).cast("double")
    fields = F.transform(F.col("_changed"), lambda p: change(p["key"], shown(p["old"]), shown(p["new"]), p["old"]["num"], p["new"]["num"]))
    typed = F.when(F.col("type_a") != F.col("type_b"), F.array(change(F.lit("type"), F.col("type_a"), F.col("type_b"), none, none))).otherwise(F.array())
    both = F.concat(typed, fields)
    plain = F.when((F.size(both) == 0) & (F.col("content_a") != F.col("content_b")), F.array(change(F.lit("content"), F.col("content_a"), F.col("content_b"), none, none))).otherwise(both)
    empty = F.array().cast("array<struct<key:string,old:string,new:string,old_num:double,new_num:double>>")
    found = joined.withColumn("_changed", changed).withColumn("field_changes", F.when(in_a & in_b, plain).otherwise(empty)).withColumn("n_changes", F.size("field_changes"))
    far = G.distance(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b")) > s.move_threshold
    found = found.withColumn("kind", deltas.kind(in_a, in_b, F.col("n_changes"), far)).where("kind IS NOT NULL").withColumn("element_type", F.coalesce("type_b", "type_a"))
    first = F.get("field_changes", F.lit(0))
    # A name without a colon, which parts a citation.
    found = found.withColumn("did", F.translate(F.concat_ws(".", F.col("bucket"), F.lpad(F.coalesce("ord_b", "ord_a").cast("string"), 6, "0"), F.when(in_b, "b").otherwise("a")), ":", ".")).withColumn("field", first["key"])
    found = found.withColumn("old_num", F.when(F.col("n_changes") == 1, first["old_num"])).withColumn("new_num", F.when(F.col("n_changes") == 1, first["new_num"]))
    # A family is made of modifications alone; other rows have no field and so no offset.
    found = deltas.cascades(found, ["pair_id", "sheet", "kind"], s)
    names = F.transform(F.col("field_changes"), lambda f: f["key"])
    return found.select(
        "pair_id", "sheet", "did", "kind", "element_type", "id_a", "id_b", "zone_a", "zone_b", "field_changes",
        deltas.confidence(in_a, in_b, F.col("confidence_a"), F.col("confidence_b"), F.col("margin"), F.col("near_miss"), s).alias("confidence"),
        X.describe(F.col("kind"), F.col("element_type"), F.col("content_a"), F.col("content_b"), F.col("zone_a"), F.col("zone_b"), F.col("n_changes"), F.col("field"), first["old"], first["new"]).alias("description"),
        "is_cascade", "primary_did", deltas.severity(F.col("kind"), F.col("element_type"), names, F.col("is_cascade")).alias("severity"),
        F.coalesce(deltas.semantic_null(F.col("kind"), F.col("element_type"), names, F.col("is_cascade")), F.lit(False)).alias("semantic_null"),
    )


def with_images(found: Comparison, images: DataFrame, s: Settings = DEFAULT, otsu: bool = False) -> Comparison:
    """The comparison with what its pages' images(pair_id, side, sheet, content) show beyond it, as visual changes.

    They follow the other changes, have no elements and keep their own box.
    """
    accepted = found.transforms.join(found.precheck.where("is_pair").select("pair_id"), "pair_id", "left_semi")
    regions = raster.page_regions(images, accepted, s, otsu)
    order = Window.partitionBy("pair_id", "sheet").orderBy("y0", "x0", "y1", "x1")
    numbered = regions.withColumn("region_id", F.row_number().over(order).cast("long")).withColumn("box", G.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    visual = with_residue(found, numbered.select("pair_id", "sheet", "region_id", "box", "area_px", "magnitude"), s)
    kind = F.lit("unclassified_visual_change")
    none = lambda t: F.lit(None).cast(t)
    types = dict(found.deltas.dtypes)
    extra = visual.select(
        "pair_id", "sheet", F.concat(F.lit("visual."), F.lpad(F.col("region_id").cast("string"), 6, "0")).alias("did"), kind.alias("kind"), F.col("visual_change_kind").alias("element_type"),
        none("string").alias("id_a"), none("string").alias("id_b"), F.col("zone").alias("zone_a"), F.col("zone").alias("zone_b"), F.array().cast(types["field_changes"]).alias("field_changes"), "confidence",
        F.concat(F.lit("visual change ("), F.col("visual_change_kind"), F.lit(") in zone "), F.col("zone")).alias("description"), F.lit(False).alias("is_cascade"), none(types["primary_did"]).alias("primary_did"),
        deltas.severity(kind, F.col("visual_change_kind"), F.array().cast("array<string>"), F.lit(False)).alias("severity"), F.lit(False).alias("semantic_null"), "box",
    )
    return replace(found, deltas=found.deltas.withColumn("box", none("struct<x0:double,y0:double,x1:double,y1:double>")).unionByName(extra))


def with_residue(found: Comparison, regions: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Regions (pair_id, sheet, region_id, box, area_px, magnitude) that the comparison does not account for."""
    changed = found.deltas.join(found.elements.select("pair_id", F.col("id"), "side", "box"), (F.col("id") == F.coalesce("id_b", "id_a")) & (found.deltas["pair_id"] == found.elements["pair_id"]))
    boxes = changed.select(found.deltas["pair_id"], found.deltas["sheet"], "box").distinct()
    return raster.residue(regions, boxes, found.elements, s)
