"""Calls of language models from executors, and who answers and judges.

A client is a picklable callable (system, prompt, temperature) -> text; nothing here
knows a provider. Calls run in the tasks that hold the prompts, a few at a time in
each. One that fails is tried once more without a temperature, since some servers
refuse that parameter; if it fails again, its row says how. Verdicts about pairs of
texts are kept in a table that outlives a run, so no pair is judged twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Client = Callable[[str, str, float | None], str]
REPLY = "reply string, attempts int, error string"


@dataclass(frozen=True)
class Backend:
    """Where a model is asked: a bearer token is preferred to a key where both are given."""

    model: str
    base_url: str | None = None
    auth_token: str | None = None
    api_key: str | None = None

    def credentials(self) -> dict[str, str]:
        found = {"auth_token": self.auth_token} if self.auth_token else {"api_key": self.api_key} if self.api_key else None
        if found is None:
            raise RuntimeError("no credentials of a model: set an auth token or an api key")
        return found | ({"base_url": self.base_url} if self.base_url else {})


@dataclass(frozen=True)
class Backends:
    """Who answers, who judges, and whether that is one and the same, so that verdicts can be read with that in mind."""

    answers: Backend
    judges: Backend
    self_judging: bool


def backends(values: Mapping[str, str], default_model: str, prefix: str = "LLM_", judge: str = "JUDGE_") -> Backends:
    """From settings such as environment variables, read once on the driver.

    LLM_MODEL, LLM_BASE_URL, LLM_AUTH_TOKEN and LLM_API_KEY say who answers;
    JUDGE_MODEL, and the others as JUDGE_LLM_..., replace them one by one for the
    judge. Empty values count as not set, but for a judge's model.
    """
    fields = ("base_url", "auth_token", "api_key")
    read = lambda p: {f: values.get(p + f.upper()) or None for f in fields}
    answers = Backend(values.get(prefix + "MODEL", default_model), **read(prefix))
    own = {f: v for f, v in read(judge + prefix).items() if v}
    model = values.get(judge + "MODEL")
    judges = replace(answers, **own, **({} if model is None else {"model": model}))
    return Backends(answers, judges, not own and model is None)


def _call(client: Client, system: str, prompt: str, temperature: float | None) -> tuple[str | None, int, str | None]:
    attempts = [temperature] if temperature is None else [temperature, None]
    error = None
    for n, t in enumerate(attempts, 1):
        try:
            return client(system, prompt, t), n, None
        except Exception as e:  # whatever a provider's client raises; the row keeps it
            error = f"{type(e).__name__}: {e}"
    return None, len(attempts), error


def asked(requests: DataFrame, client: Client, temperature: float | None = 0.0, at_once: int = 4) -> DataFrame:
    """requests(system, prompt, ...) with reply, attempts and error (null if it was answered).

    Equal requests of a task's batch are put once. A lost task asks its batch again.
    """
    names = requests.columns
    schema = ", ".join([*[f"`{c}` {t}" for c, t in requests.dtypes], REPLY])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as queue:
            for pdf in batches:
                keys = list(zip(pdf["system"].fillna(""), pdf["prompt"].fillna(""), strict=True))
                calls = {k: queue.submit(_call, client, *k, temperature) for k in dict.fromkeys(keys)}
                found = [calls[k].result() for k in keys]
                yield pdf.assign(reply=[f[0] for f in found], attempts=pd.Series([f[1] for f in found], dtype="int32", index=pdf.index), error=[f[2] for f in found])

    return requests.select(*names).mapInPandas(run, schema)


VERDICTS = "old_content string, new_content string, judged boolean"


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def known_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The verdicts kept below a path, empty before the first run."""
    return spark.read.schema(VERDICTS).parquet(path) if _exists(spark, path) else spark.createDataFrame([], VERDICTS)


def judged(pairs: DataFrame, judge: Callable[[str | None, str | None], bool | None], path: str) -> DataFrame:
    """pairs(old_content, new_content, ...) with judged: the judge's word on each pair of texts, null where it cannot tell.

    Only pairs of texts without a verdict below ``path`` are put to the judge, each once;
    what it says is added there, undecided ones too. Null texts are texts of their own.
    """
    spark = pairs.sparkSession
    same = lambda a, b: a["old_content"].eqNullSafe(b["old_content"]) & a["new_content"].eqNullSafe(b["new_content"])
    wanted = pairs.select("old_content", "new_content").distinct()
    known = known_verdicts(spark, path)
    new = wanted.join(known, same(wanted, known), "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.astype(object).where(pdf.notna(), None)
            yield pdf.assign(judged=pd.Series([judge(a, b) for a, b in zip(texts["old_content"], texts["new_content"], strict=True)], dtype=object, index=pdf.index))

    new.mapInPandas(ask, VERDICTS).write.mode("append").parquet(path)
    # Runs that overlap can judge a pair twice; one of the two counts.
    verdicts = known_verdicts(spark, path).groupBy("old_content", "new_content").agg(F.max("judged").alias("judged"))
    return pairs.join(verdicts, same(pairs, verdicts), "left").select(*[pairs[c] for c in pairs.columns], verdicts["judged"])


def agreement(cases: DataFrame, by: list[str]) -> DataFrame:
    """by, n, n_agree, agreement_rate of cases(hand, judged): a verdict that was not read agrees with none but a missing one."""
    agree = F.col("hand").eqNullSafe(F.col("judged"))
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(agree).alias("n_agree"), F.round(F.count_if(agree) / F.count(F.lit(1)), 4).alias("agreement_rate"))


def backend_comparison(calls: DataFrame, by: list[str]) -> DataFrame:
    """by, n_calls, mean_latency, cost of calls(latency, cost); a cost that is not known leaves the sum of the others."""
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.avg("latency"), 6).alias("mean_latency"), F.round(F.sum("cost"), 4).alias("cost"))
