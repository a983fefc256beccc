"""Instrument bubbles: tokens stacked inside a circle make one instrument tag."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from ..config import DEFAULT, Settings
from ..functions import tags as T

SHAPES = (re.compile(r"[A-Z]{2,4}"), re.compile(r"\d{2}"), re.compile(r"-?\d{3,5}"))  # function, system, loop
STACKED = "pair_id long, side string, sheet int, circle int, text string, func int, tokens array<int>"


def stack_bubbles(tokens: DataFrame, circles: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """STACKED, one row for each circle that holds a function, a system and a loop token; func is the function token's number.

    tokens(pair_id, side, sheet, ord, text, x, y) are those the classifier left
    unknown; circles(pair_id, side, sheet, ord, x0, y0, x1, y1). A circle reaches
    beyond its box by a share of its own size. Circles go in order and use up their
    tokens, so a page is folded as a whole.
    """

    def run(key, t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        t, used, out = t.sort_values("ord"), set(), []
        for k in c.sort_values("ord").itertuples():
            pad_x, pad_y = s.bubble_padding * (k.x1 - k.x0), s.bubble_padding * (k.y1 - k.y0)
            inside = [x for x in t.itertuples() if x.ord not in used and k.x0 - pad_x <= x.x <= k.x1 + pad_x and k.y0 - pad_y <= x.y <= k.y1 + pad_y]
            picked = [next((x for x in inside if shape.fullmatch(x.text.strip())), None) for shape in SHAPES]
            if all(picked) and len({x.ord for x in picked}) == 3:
                func, system, loop = (x.text.strip() for x in picked)
                text = f"{func} {loop} {system}"
                if re.match(T.INSTRUMENT, text):
                    used |= {x.ord for x in picked}
                    out.append((*key, k.ord, text, picked[0].ord, sorted(x.ord for x in picked)))
        return pd.DataFrame(out, columns=["pair_id", "side", "sheet", "circle", "text", "func", "tokens"])

    page = ["pair_id", "side", "sheet"]
    return tokens.groupBy(*page).cogroup(circles.groupBy(*page)).applyInPandas(run, STACKED)
