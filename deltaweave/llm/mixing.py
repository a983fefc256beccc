"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of BLOCK_BYTES in a fixed pseudo-random order of
its documents. Target weights become whole shares a of a cycle of D slots. Block
i of a source may not run before slot floor(i * D / a), its release, and must run
before slot ceil((i + 1) * D / a), its deadline. Among the released blocks the
earliest deadline goes first, which keeps every source within less than one block
of its target at every slot. All windows start anew after D slots, so one cycle
is scheduled, from the shares alone, and block i takes its place in cycle i div a.

The m sources of one share a are scheduled as one with share m * a, whose slots go
to them in turn: the window of its block i * m + j lies inside that of block i of
the j-th of them, so nothing is lost. There are fewer than sqrt(2 D) different
shares, so many sources (domains, say) cost little.

Only DataFrame functions are used. A document's place in its source comes from
sums over 4096 buckets and a prefix sum over these, so a source that holds most
rows is never gathered in one task.

A source that runs out leaves its later slots empty and the rest keep their
order. ``in_mix`` marks what lies before the slot at which sources with over
1 - COVERAGE of the weight have run out: up to there the corpus has the target
weights. No row is left out of the result.

Defined cases: null and empty sources are one source named ''; a null text has
one byte, as an empty one; equal doc_ids are ordered by text hash and share a
place only if wholly equal; an empty table gives none; extra columns are ignored;
sources absent from given weights count as weight 0 and get one slot a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch

BLOCK_BYTES = 32 * 1024
CYCLE = 1000
EXPONENT = 0.7
COVERAGE = 0.9
#: Slots that are scheduled together.
PART = 256
#: Slots of a cycle up to which shares and pattern are broadcast.
BROADCAST_ROWS = 500_000


def shares(sizes: DataFrame, weights: dict[str, float] | None, cycle: int, exponent: float) -> DataFrame:
    """source, share: whole slots of the cycle, at least one, near weight * cycle."""
    if weights is None:
        weight: Column = F.pow(F.col("total").cast("double"), F.lit(exponent))
    else:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")].cast("double"), F.lit(0.0))
    whole = sizes.agg(F.sum(weight)).first()[0] or 1.0  # one number
    return sizes.select("source", "total", F.greatest(F.lit(1), F.floor(weight * cycle / F.lit(float(whole)) + 0.5)).cast("long").alias("share"))


def cycle_pattern(shared: DataFrame) -> DataFrame:
    """source, turn, slot: one cycle by earliest deadline first among released blocks of the pools of equal share."""
    pools = shared.groupBy("share").agg(F.array_sort(F.collect_list("source")).alias("names")).withColumn("m", F.size("names").cast("long"))
    one = pools.agg(F.array_sort(F.collect_list(F.struct("share", (F.col("share") * F.col("m")).alias("a")))).alias("s")).where("size(s) > 0").select(
        F.col("s.share").alias("shares"), F.col("s.a").alias("a")
    )
    # Slots are folded in parts, so that no step copies more than the slots of its part.
    simulated = one.selectExpr(
        "shares", "a", "aggregate(a, 0L, (x, y) -> x + y) AS d"
    ).selectExpr(
        "shares",
        f"""flatten(aggregate(
             sequence(0L, (d - 1) div {PART}L),
             named_struct('n', transform(a, x -> 0L), 'got', cast(array() AS array<array<int>>)),
             (whole, part) -> transform(
               array(aggregate(
                 sequence(part * {PART}L, least((part + 1) * {PART}L, d) - 1),
                 named_struct('n', whole.n, 'got', cast(array() AS array<int>)),
                 (acc, t) -> transform(
                   array(array_min(transform(
                     filter(sequence(0, size(a) - 1), s -> get(acc.n, s) < get(a, s) AND (get(acc.n, s) * d) div get(a, s) <= t),
                     s -> struct(((get(acc.n, s) + 1) * d + get(a, s) - 1) div get(a, s) AS deadline, s AS s)
                   )).s),
                   pick -> named_struct('n', transform(acc.n, (x, j) -> if(j = pick, x + 1, x)), 'got', concat(acc.got, array(pick)))
                 )[0]
               )),
               done -> named_struct('n', done.n, 'got', concat(whole.got, array(done.got)))
             )[0]
           ).got) AS got""",
    )
    slots = simulated.select("shares", F.posexplode("got").alias("slot", "pick")).select(F.get("shares", F.col("pick")).alias("share"), F.col("slot").cast("long"))
    slots = slots.withColumn("k", (F.row_number().over(Window.partitionBy("share").orderBy("slot")) - 1).cast("long"))
    members = pools.select("share", "m", F.posexplode("names").alias("j", "source"))
    turned = slots.join(pools.select("share", "m"), "share").withColumn("j", (F.col("k") % F.col("m")).cast("int")).withColumn("turn", F.floor(F.col("k") / F.col("m")).cast("long"))
    return turned.drop("m").join(members.drop("m"), ["share", "j"]).select("source", "turn", "slot")


def schedule(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_bytes: int = BLOCK_BYTES,
    cycle: int = CYCLE,
    exponent: float = EXPONENT,
    coverage: float = COVERAGE,
) -> DataFrame:
    """doc_id, source, bytes, offset, block, release, deadline, slot, in_mix for every row of docs."""
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.keep(
        docs.select(
            "doc_id",
            F.coalesce("source", F.lit("")).alias("source"),
            (F.octet_length(text) + 1).cast("long").alias("bytes"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_key"),
            F.md5(text).alias("_text"),
        ).withColumn("_bucket", F.substring("_key", 1, 3)),
        "rows",
    )
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("bytes").alias("_in"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = buckets.withColumn("_first", F.coalesce(F.sum("_in").over(earlier), F.lit(0))).drop("_in")
    sizes = rows.groupBy("source").agg(F.sum("bytes").alias("total"))
    shared = scratch.keep(shares(sizes, weights, cycle, exponent), "shares")
    pattern = scratch.keep(cycle_pattern(shared), "pattern")
    slots = shared.agg(F.sum("share")).first()[0] or 1  # of a cycle
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("_in", F.coalesce(F.sum("bytes").over(within), F.lit(0)))
        .join(firsts, ["source", "_bucket"])
        .withColumn("offset", F.col("_first") + F.col("_in"))
        .withColumn("block", F.floor(F.col("offset") / block_bytes).cast("long"))
    )
    # The pattern has a row for each slot of a cycle, no fewer than there are shares.
    sent = F.broadcast if slots <= BROADCAST_ROWS else lambda df: df
    plan = sent(shared.drop("total"))
    ends = (
        shared.withColumn("_n", F.floor(F.col("total") / block_bytes).cast("long"))
        .withColumn("turn", F.col("_n") % F.col("share"))
        .join(sent(pattern), ["source", "turn"])
        .select("share", "source", (F.floor(F.col("_n") / F.col("share")) * slots + F.col("slot")).cast("long").alias("_end"))
    )
    before = Window.orderBy("_end", "source").rowsBetween(Window.unboundedPreceding, 0)  # a row for each source
    gone = ends.withColumn("_gone", F.sum("share").over(before))
    horizon = gone.where(F.col("_gone") > (1 - coverage) * slots).agg(F.min("_end")).first()[0] or 0
    slot = F.floor(F.col("block") / F.col("share")) * slots + F.col("slot")
    return (
        placed.join(plan, "source")
        .withColumn("turn", F.col("block") % F.col("share"))
        .join(sent(pattern), ["source", "turn"])
        .select(
            "doc_id",
            "source",
            "bytes",
            F.col("offset").cast("long").alias("offset"),
            "block",
            F.floor(F.col("block") * slots / F.col("share")).cast("long").alias("release"),
            F.ceil((F.col("block") + 1) * slots / F.col("share")).cast("long").alias("deadline"),
            slot.cast("long").alias("slot"),
            (slot < horizon).alias("in_mix"),
        )
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, **settings) -> DataFrame:
    """Every row of docs, laid out in the order of its slots; in_mix leaves none out.

    The rows of a doc_id, null among them, stand together at the first of their places.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    placed = schedule(docs, weights, **settings).groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct("slot", "offset")).alias("_at"))
    placed = scratch.keep(placed, "placed")
    same = docs["doc_id"].eqNullSafe(placed["_id"])
    joined = scratch.keep(docs.join(placed, same, "left").select(*[docs[c] for c in docs.columns], "_at"), "joined")  # so texts are never in two shuffles at a time
    return joined.repartitionByRange("_at").sortWithinPartitions("_at").drop("_at")


ORACLE = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, coalesce(source, '') AS source, strlen(coalesce(text, '')) + 1 AS bytes, md5(coalesce(doc_id::VARCHAR, '')) AS k, md5(coalesce(text, '')) AS tk FROM documents
), o AS (
  SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY substr(k, 1, 3), k, doc_id, tk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r
), z AS (SELECT source, CAST(sum(bytes) AS BIGINT) AS total FROM r GROUP BY source),
s AS (
  SELECT source, total, greatest(1, CAST(floor(power(total::DOUBLE, {EXPONENT}) * {CYCLE} / sum(power(total::DOUBLE, {EXPONENT})) OVER () + 0.5) AS BIGINT)) AS share FROM z
), g AS (SELECT share, count(*) AS m, list(source ORDER BY source) AS names FROM s GROUP BY share
), l AS (SELECT list(share ORDER BY share) AS shares, list(share * m ORDER BY share) AS a, CAST(sum(share * m) AS BIGINT) AS d FROM g),
sim AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(a, lambda x: 0::BIGINT) AS n, CAST(NULL AS BIGINT) AS pick FROM l
  UNION ALL
  SELECT t + 1, list_transform(n, lambda x, j: CASE WHEN j = p THEN x + 1 ELSE x END), p FROM (
    SELECT sim.t, sim.n, (list_min(list_transform(
        list_filter(range(1, len(a) + 1), lambda q: n[q] < a[q] AND (n[q] * d) // a[q] <= t),
        lambda q: (((n[q] + 1) * d + a[q] - 1) // a[q]) * 1000000 + q)) % 1000000)::BIGINT AS p
    FROM sim, l WHERE sim.t < l.d) x
), turns AS (
  SELECT shares[pick] AS share, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM sim, l WHERE pick IS NOT NULL
), pattern AS (
  SELECT g.names[turns.k % g.m + 1] AS source, turns.slot, turns.k // g.m AS turn FROM turns JOIN g ON turns.share = g.share
), e AS (
  SELECT s.source, s.share, ((s.total // {BLOCK_BYTES}) // s.share) * l.d + p.slot AS fin
  FROM s, l, pattern p WHERE p.source = s.source AND p.turn = (s.total // {BLOCK_BYTES}) % s.share
), h AS (
  SELECT min(fin) AS horizon FROM (SELECT fin, sum(share) OVER (ORDER BY fin, source ROWS UNBOUNDED PRECEDING) AS gone FROM e) x, l WHERE gone > (1 - {COVERAGE}) * l.d
)
SELECT o.doc_id, o.source, CAST(o.bytes AS BIGINT) AS bytes, o."offset", o."offset" // {BLOCK_BYTES} AS block,
  ((o."offset" // {BLOCK_BYTES}) * l.d) // s.share AS release,
  ((o."offset" // {BLOCK_BYTES} + 1) * l.d + s.share - 1) // s.share AS deadline,
  ((o."offset" // {BLOCK_BYTES}) // s.share) * l.d + p.slot AS slot,
  ((o."offset" // {BLOCK_BYTES}) // s.share) * l.d + p.slot < h.horizon AS in_mix
FROM o JOIN s ON o.source = s.source JOIN pattern p ON p.source = s.source AND p.turn = (o."offset" // {BLOCK_BYTES}) % s.share, l, h
"""
