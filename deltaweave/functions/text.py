"""Column builders over strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The citation format, and what counts as a token.
CITATION = r"\[([^:\[\]]+):([^:\[\]]+):([^:\[\]]+):([^:\[\]]+)\]"
TOKEN = r"[A-Za-z0-9\"'/.\-]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokenise(c: Column) -> Column:
    """Lower-cased tokens, then the non-empty parts of those with hyphens.

    Tokens are ASCII, so case is folded before they are cut. The array stands in a
    lambda's variable, which is computed once however often it is read.
    """
    whole = F.regexp_extract_all(F.translate(c, UPPER, LOWER), F.lit(f"({TOKEN})"), 1)
    parts = lambda w: F.filter(F.flatten(F.transform(F.filter(w, lambda t: t.contains("-")), lambda t: F.split(t, "-"))), lambda p: p != "")
    return F.get(F.transform(F.array(whole), lambda w: F.concat(w, parts(w))), F.lit(0))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by rows of the table; for short strings."""
    cells = F.split(b, "")
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda i: F.lit(0))

    def step(row: Column, ch: Column) -> Column:
        # Each new row grows from its left neighbour, which ``aggregate`` carries along.
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda new, j: F.concat(
                new,
                F.array(F.when(F.get(cells, j - 1) == ch, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.element_at(new, -1)))),
            ),
        )

    whole = F.aggregate(F.split(a, ""), zero, step, lambda row: F.element_at(row, -1))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(whole)


def indel_similarity(a: Column, b: Column) -> Column:
    """2 * LCS / (length a + length b); two empty strings are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs_length(a, b) / total)


def citation(source: Column, sheet: Column, zone: Column, id_: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(":", source, sheet.cast("string"), F.when(F.coalesce(zone, F.lit("")) == "", "-").otherwise(zone), id_), F.lit("]"))


def parse_citations(c: Column) -> Column:
    """Array of raw, source, sheet, zone, id in order of appearance."""
    raw = F.regexp_extract_all(c, F.lit(f"({CITATION})"), 1)
    part = lambda r, i: F.regexp_extract(r, CITATION, i)
    return F.transform(raw, lambda r: F.struct(r.alias("raw"), part(r, 1).alias("source"), part(r, 2).alias("sheet"), part(r, 3).alias("zone"), part(r, 4).alias("id")))


def sentence_before(text: Column, raw: Column, window: int = 200) -> Column:
    """What stands up to ``window`` characters before a citation, with it; the whole text if it is absent."""
    at = F.instr(text, raw)
    start = F.greatest(F.lit(1), at - window)
    return F.when(at == 0, text).otherwise(strip(F.substr(text, start, at - start + F.length(raw))))


def cost_estimate(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Cost for rates given per thousand tokens; null unless both are set."""
    return F.round(tokens_in / 1000 * rate_in + tokens_out / 1000 * rate_out, 6)


def describe(kind: Column, type_: Column, content_a: Column, content_b: Column, zone_a: Column, zone_b: Column, n_fields: Column, field: Column, old: Column, new: Column) -> Column:
    one = F.concat(type_, F.lit(" "), field, F.lit(" changed: "), F.coalesce(old, F.lit("None")), F.lit(" -> "), F.coalesce(new, F.lit("None")))
    quoted = lambda c, n: F.concat(F.lit("'"), F.substring(c, 1, n), F.lit("'"))
    return (
        F.when(kind == "add", F.concat(type_, F.lit(" added: "), F.substring(content_b, 1, 60)))
        .when(kind == "remove", F.concat(type_, F.lit(" removed: "), F.substring(content_a, 1, 60)))
        .when(kind == "move", F.concat(quoted(content_a, 50), F.lit(" moved "), F.coalesce(zone_a, F.lit("None")), F.lit(" -> "), F.coalesce(zone_b, F.lit("None"))))
        .when(n_fields == 1, one)
        .otherwise(F.concat(quoted(content_a, 40), F.lit(" -> "), quoted(content_b, 40)))
    )


def verdict(reply: Column) -> Column:
    """struct(correct, reason): null and the whole reply where it cannot be read."""
    t = strip(reply)
    word = F.upper(F.regexp_extract(t, r"(?i)^(correct|incorrect)\b", 1))
    return F.struct(
        F.when(word == "CORRECT", True).when(word == "INCORRECT", False).alias("correct"),
        F.when(word == "", t).otherwise(F.regexp_replace(t, r"(?i)^(correct|incorrect)[\s:.,-]*", "")).alias("reason"),
    )
