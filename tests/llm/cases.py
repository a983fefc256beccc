"""Small tables with every odd case, and columns whose names clash with those operators make."""

from __future__ import annotations

import random

EXTRA = "h bigint, row bigint, fp bigint, n bigint, bytes bigint, shard int, slot bigint, score double, hash bigint, anchor bigint, block int, _bucket int, least bigint, places int, count int, c int"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"

PASSAGE = " ".join(f"w{i}" for i in range(60))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "Ke", "lü", "mo", "ти") for b in ("", "na", "ra", "st", "文")]
    plain = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows: list[tuple[int | None, str | None, str | None]] = [(i, plain(r.randint(40, 120)), f"s{i % 3}") for i in range(30)]
    rows += [(100, None, "s0"), (101, "", None), (102, " \t\n ", ""), (103, "x", "s1"), (104, "one\x0btwo\x0cthree", "s1")]
    rows += [(105, plain(10) + " " + PASSAGE + "  " + plain(5), "s2"), (106, PASSAGE + "\n" + plain(7), "s2"), (107, plain(3) + " " + PASSAGE, "s0")]
    rows += [(108, plain(6000), "s0"), (109, "y" * 50_000, "s0"), (110, "rep " * 500, "s1")]
    rows += [(111, rows[3][1], "s2"), (112, rows[3][1], "s2"), (113, rows[3][1], "s2"), (114, (rows[4][1] or "").upper(), "s0")]
    rows += [(115, plain(50), "s0"), (115, plain(50), "s0")]  # one id, two texts
    rows += [rows[5], rows[5]]  # wholly repeated rows
    rows += [(None, plain(45), "s1"), (None, None, None)]
    rows += [(116, "A non-breaking space and   line", "s1"), (117, "é é İ ı ß ẞ", "s1")]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    made = [(i, t, "en", s, len(t or ""), *[7] * 7, 0.5, *[3] * 8) for i, t, s in rows]
    return spark.createDataFrame(made, DOCS)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()  # bytes: lower() and split() are ASCII
