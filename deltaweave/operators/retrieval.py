"""Chunks, ranked lexical retrieval, citations and the answer gate."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import citation, parse_citations, strip, tokenise
from .dealing import dealt

REFUSAL = "REFUSED:"

#: Own vocabulary: a phrase in a question adds words to it.
ALIASES = (
    ("shut down", "trip"), ("shutdown", "trip"), ("set point", "setpoints"), ("setpoint", "setpoints"), ("taken out", "removed"),
    ("deleted", "removed"), ("new", "added"), ("renumber", "loop"), ("valve", "valve_tag"), ("pipe", "line_tag"), ("vessel", "equipment_tag"),
)


def chunks(elements: DataFrame, deltas: DataFrame) -> DataFrame:
    """source, id, sheet, zone, content, kind: every citable element of either side, and every change."""
    e = elements.where(~F.col("type").isin("geometry", "zone_label") & (strip(F.col("content")) != ""))
    text = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.concat_ws(" ", "kind", "element_type"))
    return e.select("pair_id", F.col("side").alias("source"), "id", "sheet", "zone", "content", F.col("type").alias("kind")).unionByName(
        deltas.select("pair_id", F.lit("delta").alias("source"), F.col("did").alias("id"), "sheet", F.coalesce("zone_b", "zone_a").alias("zone"), text.alias("content"), "kind")
    )


def expand_query(questions: DataFrame, aliases: DataFrame, *more: str) -> DataFrame:
    """question_id, more columns of the questions, term: the targets of every alias phrase that the lower-cased question contains.

    The alias table is a fixed vocabulary, so it is the broadcast side.
    """
    hit = F.contains(F.lower(F.col("question")), F.col("phrase"))
    return questions.join(F.broadcast(aliases), hit).select("question_id", *more, F.col("target").alias("term"))


def load_aliases(spark: SparkSession, path: str | None = None) -> DataFrame:
    """phrase, target: the own vocabulary, or that of a JSON file of phrases and lists of targets; a file that is not there gives none."""
    pairs = list(ALIASES)
    if path is not None:
        try:
            text = "\n".join(r.value for r in spark.read.text(path).collect())  # a vocabulary, read on the driver
            pairs = [(phrase.lower(), target) for phrase, targets in json.loads(text).items() for target in targets]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            pairs = []
    return spark.createDataFrame(pairs, "phrase string, target string")


def indexed_tokens(content: Column, zone: Column) -> Column:
    """What a chunk is found by: the tokens of its content, then the word zone and those of its zone, if it has one."""
    none = F.array().cast("array<string>")
    named = F.when(F.coalesce(zone, F.lit("")) != "", F.concat(F.array(F.lit("zone")), tokenise(zone))).otherwise(none)
    return F.concat(F.coalesce(tokenise(content), none), named)


def search(chunked: DataFrame, questions: DataFrame, aliases: DataFrame | None = None, s: Settings = DEFAULT) -> DataFrame:
    """question_id, rank, score and the chunk of the best chunks of a question's own pair.

    chunked is of chunks(); questions are (question_id, pair_id, question). Every pair
    is an index of its own, so its counts are aggregates by pair and all joins carry
    it. Changes count one and a half times; equal scores go by source, sheet and id.
    Only postings of terms that a pair is asked for are shuffled.
    """
    questions, chunked = dealt(questions, "pair_id"), dealt(chunked, "pair_id")  # as short rows, before they are cut into terms
    asked = questions.select("question_id", "pair_id", F.explode(tokenise(F.col("question"))).alias("term"))
    if aliases is not None:
        asked = asked.unionByName(expand_query(questions, aliases, "pair_id"))
    asked = asked.groupBy("question_id", "pair_id", "term").agg(F.count(F.lit(1)).alias("times"))
    key = ["pair_id", "source", "sheet", "zone", "id", "content"]
    terms = chunked.select(*key, indexed_tokens(F.col("content"), F.col("zone")).alias("_t")).withColumn("dl", F.size("_t").cast("long"))
    stats = terms.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))
    wanted = asked.groupBy("pair_id").agg(F.collect_set("term").alias("_w"))  # the words of a pair's questions
    # A chunk's terms are counted within its row.
    hit = F.transform(F.array_intersect("_t", "_w"), lambda w: F.struct(w.alias("term"), F.size(F.filter("_t", lambda x: x == w)).alias("tf")))
    post = terms.join(wanted, "pair_id").select(*key, "dl", F.explode(hit).alias("_h")).select(*key, "dl", "_h.*")
    df = post.groupBy("pair_id", "term").agg(F.count(F.lit(1)).alias("df"))
    found = post.join(df, ["pair_id", "term"]).join(asked, ["pair_id", "term"]).join(stats, "pair_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + s.k1 * (1 - s.b + s.b * F.col("dl") / (F.col("total") / F.col("n")))
    boost = F.when(F.col("source") == "delta", s.delta_boost).otherwise(1.0)
    scores = found.groupBy("question_id", *key).agg(F.round(F.sum(F.col("times") * idf * F.col("tf") * (s.k1 + 1) / norm * boost), 6).alias("score")).where("score > 0")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "source", "sheet", "id")
    return scores.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= s.top_k)


def postings(docs: DataFrame, text: Column, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, term, tf, dl (the document's length), of the terms in wanted(term) alone if it is given.

    Lengths come along with the tokens, so no second pass over a document's terms is
    needed. explode_outer, since explode would have the optimizer tokenise twice.
    """
    tokens = docs.select("doc_id", tokenise(text).alias("_t")).select("doc_id", F.size("_t").cast("long").alias("dl"), F.explode_outer("_t").alias("term")).where("term IS NOT NULL")
    if wanted is not None:
        tokens = tokens.join(wanted.select("term").distinct(), "term", "left_semi")
    return tokens.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


#: No token is empty, so an empty term can stand for a document as such.
WHOLE = ""


def counted(docs: DataFrame, text: Column, wanted: DataFrame) -> DataFrame:
    """doc_id, dl, term, tf as of postings, and a row of the term WHOLE for each document; stored, it serves both ``postings`` and ``totals`` with texts read once."""
    terms = wanted.select("term").unionByName(wanted.sparkSession.createDataFrame([(WHOLE,)], "term string")).distinct()
    tokens = docs.select("doc_id", tokenise(F.coalesce(text, F.lit(""))).alias("_t"))
    every = tokens.select("doc_id", F.size("_t").cast("long").alias("dl"), F.explode(F.concat("_t", F.array(F.lit(WHOLE)))).alias("term"))
    return every.join(terms, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def split_counted(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings, and one row (n, total) of all documents, of what ``counted`` has stored. Rows of one id and length count as often as there are."""
    totals = found.where(F.col("term") == WHOLE).agg(F.sum("tf").alias("n"), F.sum(F.col("dl") * F.col("tf")).alias("total"))
    return found.where(F.col("term") != WHOLE), totals


def bm25(
    post: DataFrame, n_docs: DataFrame, query_terms: DataFrame, s: Settings = DEFAULT, boost: Column | None = None, only_wanted: bool = False, folder: str | None = None, parts: int | None = None
) -> DataFrame:
    """question_id, doc_id, score. query_terms(question_id, term) counts a repeated term each time; only_wanted: postings hold no other terms.

    n_docs has one row (n, the number of documents with or without terms, and their
    total length), so only the query's postings are shuffled: idf comes from counts
    of the queried terms alone. With a folder the terms' weights are stored there, so
    that their size is known when they are joined; with parts the postings are dealt by
    document, so that scores are summed where their postings are and none is shuffled.
    """
    asked = query_terms.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = post if only_wanted else post.join(asked.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.join(asked, "term").join(F.broadcast(n_docs), how="cross").select("question_id", "term", (F.col("times") * idf).alias("_w"), (F.col("total") / F.col("n")).alias("_mean"))
    if folder is not None:
        weights.write.parquet(folder)
        weights = post.sparkSession.read.schema(weights.schema).parquet(folder)
    if parts is not None:
        wanted = wanted.repartition(parts, "doc_id")
    norm = F.col("tf") + s.k1 * (1 - s.b + s.b * F.col("dl") / F.col("_mean"))
    part = F.col("_w") * F.col("tf") * (s.k1 + 1) / norm
    return wanted.join(weights, "term").groupBy("question_id", "doc_id").agg(F.sum(part * boost if boost is not None else part).alias("score")).where("score > 0")


def top_k(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best of each question, equal scores (to ``digits``) by document."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def context_lines(found: DataFrame) -> DataFrame:
    """question_id, context: one line for each hit, its citation first, in the order of ranks."""
    line = F.concat_ws(" ", citation(F.col("source"), F.col("sheet"), F.col("zone"), F.col("id")), F.col("content"))
    return found.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def cited(answers: DataFrame) -> DataFrame:
    """answer_id, place, raw, source, sheet, zone, id of each citation."""
    return answers.select("answer_id", F.posexplode(parse_citations(F.col("answer"))).alias("place", "c")).select("answer_id", "place", "c.*")


def validate(citations: DataFrame, known: DataFrame) -> DataFrame:
    """Adds valid: the id is among known(answer_id, id); source, sheet and zone may be mistyped."""
    ids = known.select("answer_id", "id").distinct().withColumn("_known", F.lit(True))
    return citations.join(ids, ["answer_id", "id"], "left").withColumn("valid", F.col("_known").isNotNull()).drop("_known")


def gate(answers: DataFrame, validated: DataFrame, hits: DataFrame) -> DataFrame:
    """answer_id, refused, reason, n_valid: an answer stands only with hits, without refusal, and with known citations alone."""
    counts = validated.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("valid")).alias("ok"))
    found = hits.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_hits"))
    all_ = answers.join(found, "answer_id", "left").join(counts, "answer_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = (
        F.when(zero("n_hits") == 0, "no_evidence").when(strip(F.col("answer")).startswith(REFUSAL), "model_refused").when(zero("n") == 0, "no_citation").when(zero("ok") < zero("n"), "unknown_citation").otherwise("")
    )
    return all_.select("answer_id", (reason != "").alias("refused"), reason.alias("reason"), zero("ok").cast("long").alias("n_valid"))
