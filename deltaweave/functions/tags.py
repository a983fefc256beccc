"""Grammar of drawing tags, and the tiered classifier of text runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import zone_label_shaped
from .text import strip

# The shape of each tag.
LINE_TAG = r'^([\d/"x ]+)-([A-Z]{2})-(\d{2})-(\d{4})-([A-Z0-9]+)-(\d{2})'
INSTRUMENT = r"^([A-Z]{2,4})\s+(-?\d{3,5})\s+(\d{2})(?:\s+SD\s+HH:(-?\d+)\s+LL:(-?\d+))?$"
VALVE_TAG = r"^(\d{2})([A-Z]{2})(\d{3,4})$"
NOZZLE = r"^N(\d{3,4})$"
EQUIPMENT_TAG = r"^(\d{2})-([A-Z]{2,4})-(\d{3})$"
DRAWING_NUMBER = r"^[A-Z0-9]+-PID-\d+-\d+-\d+$"
REVISION = r"^REV\s+([A-Z])$"
SHEET = r"^SHEET\s+(\d+)\s+OF\s+(\d+)$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
DCN = r"DCN-KP-\d{4}-\d"
DELETED_NOTE = r"^\d+(?:-\d+)?\.\s*DELETED\.$"
NUMBERED_NOTE = r"^\d+\.\s+.+"
REVISION_ROW = r"^[A-Z]\s{1,2}\d{4}-\d{2}-\d{2}\s{1,2}.+$"
TITLE_RECTS = ((0.70, 0.85, 1.0, 1.0),)
DATASHEET_RECTS = ((0.55, 0.55, 1.0, 0.80), (0.0, 0.68, 0.25, 0.88))
TAG_TYPES = ("instrument", "line_tag", "valve_tag", "nozzle", "equipment_tag")


def _parsed(text: Column, pattern: str, **fields) -> Column:
    """A struct of groups where the pattern matches, else null."""
    t = strip(text)
    return F.when(t.rlike(pattern), F.struct(*[make(lambda i: F.regexp_extract(t, pattern, i)).alias(k) for k, make in fields.items()]))


def line_tag(text: Column) -> Column:
    names = ("size", "service", "system", "seq", "pipe_class", "insul")
    return _parsed(text, LINE_TAG, **{n: (lambda g, i=i: g(i + 1)) for i, n in enumerate(names)})


def instrument(text: Column) -> Column:
    number = lambda c: F.when(c != "", c.cast("int"))
    return _parsed(text, INSTRUMENT, func=lambda g: g(1), loop=lambda g: g(2).cast("int"), system=lambda g: g(3), hh=lambda g: number(g(4)), ll=lambda g: number(g(5)))


def valve_tag(text: Column) -> Column:
    return _parsed(text, VALVE_TAG, system=lambda g: g(1), body=lambda g: g(2), seq=lambda g: g(3))


def nozzle(text: Column) -> Column:
    return _parsed(text, NOZZLE, noz_no=lambda g: g(1).cast("int"))


def equipment_tag(text: Column) -> Column:
    return _parsed(text, EQUIPMENT_TAG, system=lambda g: g(1), type=lambda g: g(2), seq=lambda g: g(3).cast("int"))


def title_field(text: Column) -> Column:
    t = strip(text)
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("int")
    made = lambda field, value=none, n=no_number, of=no_number: F.struct(F.lit(field).alias("field"), value.alias("value"), n.alias("sheet_no"), of.alias("of"))
    return (
        F.when(t.rlike(DRAWING_NUMBER), made("drawno", t))
        .when(t.rlike(REVISION), made("rev", F.regexp_extract(t, REVISION, 1)))
        .when(t.rlike(SHEET), made("sheet", none, F.regexp_extract(t, SHEET, 1).cast("int"), F.regexp_extract(t, SHEET, 2).cast("int")))
        .when(t.rlike(DATE), made("date", t))
    )


def dcn_references(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({DCN})"), 1)


def _in_rects(x: Column, y: Column, rects) -> Column:
    inside = F.lit(False)
    for x0, y0, x1, y1 in rects:
        inside = inside | ((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1))
    return inside


#: Type, confidence and name of each rule, in the order in which they are tried.
RULES = (
    ("zone_label", 1.0, "regex:zone_label"),
    ("line_tag", 1.0, "regex:line_tag"),
    ("instrument", 1.0, "regex:instrument"),
    ("valve_tag", 1.0, "regex:valve_tag"),
    ("nozzle", 1.0, "regex:nozzle"),
    ("equipment_tag", 1.0, "regex:equipment_tag"),
    ("title_field", 1.0, "regex:title_field"),
    ("note_deleted", 1.0, "regex:note_deleted"),
    ("dcn_note", 1.0, "regex:dcn_note"),
    ("rev_row", 1.0, "regex:rev_row"),
    ("note", 1.0, "regex:note"),
    ("datasheet_row", 0.5, "region:datasheet"),
    ("title_field", 0.5, "region:title_block"),
    ("unknown", 0.1, "fallback:empty"),
    ("unknown", 0.3, "fallback:tag_like"),
    ("text", 0.3, "fallback:text"),
)


def _once(c: Column, make) -> Column:
    """make(value) of a column that is computed once, however often make reads it."""
    return F.get(F.transform(F.array(c), make), F.lit(0))


def classify(text: Column, x: Column, y: Column) -> Column:
    """struct(type, confidence, rule): the first rule that fits, from shapes to places to leftovers.

    Only the rule's number is decided by cases; the rest is looked up, so the code that Spark makes stays small.
    """

    def rule(t: Column) -> Column:
        tests = [
            zone_label_shaped(t, x, y), t.rlike(LINE_TAG), t.rlike(INSTRUMENT), t.rlike(VALVE_TAG), t.rlike(NOZZLE), t.rlike(EQUIPMENT_TAG),
            t.rlike("|".join((DRAWING_NUMBER, REVISION, SHEET, DATE))), t.rlike(DELETED_NOTE), t.rlike(DCN) & t.rlike(NUMBERED_NOTE), t.rlike(REVISION_ROW), t.rlike(NUMBERED_NOTE),
            _in_rects(x, y, DATASHEET_RECTS), _in_rects(x, y, TITLE_RECTS), t == "", ~t.contains(" ") & (F.length(t) <= 20),
        ]
        out = F.when(tests[0], 0)
        for i, test in enumerate(tests[1:], 1):
            out = out.when(test, i)
        return out.otherwise(len(tests))

    looked = F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).alias("confidence"), F.lit(c).alias("rule")) for a, b, c in RULES])
    return _once(strip(text), lambda t: F.get(looked, rule(t)))


def attributes(text: Column, type_: Column) -> Column:
    """Array of struct(key, num, str): what a run of the given type carries; lists and pairs are canonical strings."""
    return _once(strip(text), lambda t: _attributes(t, type_))


def _attributes(t: Column, type_: Column) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    num = lambda k, c: F.struct(F.lit(k).alias("key"), c.cast("double").alias("num"), none("string").alias("str"))
    word = lambda k, c: F.struct(F.lit(k).alias("key"), none("double").alias("num"), c.cast("string").alias("str"))
    line, inst, valve, equip, title = line_tag(t), instrument(t), valve_tag(t), equipment_tag(t), title_field(t)
    number = F.regexp_extract(t, r"^(\d+)", 1)
    ranged = F.regexp_extract(t, r"^(\d+-\d+)\.", 1)
    setpoints = F.when(inst["hh"].isNotNull() & inst["ll"].isNotNull(), F.concat(F.lit("HH:"), inst["hh"].cast("string"), F.lit(" LL:"), inst["ll"].cast("string")))
    kept = lambda *items: F.filter(F.array(*items), lambda a: a["num"].isNotNull() | a["str"].isNotNull())
    return (
        F.when(type_ == "line_tag", kept(*[word(k, line[k]) for k in ("size", "service", "system", "seq", "pipe_class", "insul")]))
        .when(type_ == "instrument", kept(word("func", inst["func"]), num("loop", inst["loop"]), word("system", inst["system"]), word("setpoints", setpoints)))
        .when(type_ == "valve_tag", kept(*[word(k, valve[k]) for k in ("system", "body", "seq")]))
        .when(type_ == "nozzle", kept(num("noz_no", nozzle(t)["noz_no"])))
        .when(type_ == "equipment_tag", kept(word("system", equip["system"]), word("type", equip["type"]), num("seq", equip["seq"])))
        .when(type_ == "title_field", kept(word("field", F.coalesce(title["field"], F.lit("unknown"))), word("value", F.when(title.isNull(), t).otherwise(title["value"])), num("sheet_no", title["sheet_no"]), num("of", title["of"])))
        .when(type_ == "note_deleted", kept(word("deleted", F.lit("true")), word("range", F.when(ranged != "", ranged)), num("note_no", F.when(ranged == "", number))))
        .when(type_ == "dcn_note", kept(num("note_no", number), word("dcns", F.array_join(dcn_references(t), ","))))
        .when(type_ == "note", kept(num("note_no", number)))
        .when(type_ == "datasheet_row", kept(word("value", t)))
        .otherwise(F.array().cast("array<struct<key:string,num:double,str:string>>"))
    )


def match_group(type_: Column) -> Column:
    """Types that may match each other share a group."""
    return F.when(type_.isin("note", "note_deleted", "dcn_note"), "dcn_note|note|note_deleted").otherwise(type_)


def element_id(sheet: Column, type_: Column, content: Column, b: Column) -> Column:
    """A name that depends on sheet, type, content and box (four decimals) alone."""
    at = F.concat_ws(",", *[F.format_string("%.4f", b[k]) for k in ("x0", "y0", "x1", "y1")])
    return F.concat(F.lit("el_"), F.substring(F.sha1(F.concat_ws("|", sheet.cast("string"), type_, content, at)), 1, 12))
