"""Decisions of a language model, as strict JSON, and the order and union of its passes.

A provider is a callable of a system text and a question that returns an answer and its number of tokens, or None. It may raise. Candidates are
asked about in batches of consecutive paths, so a repository of any size is many rows; a large change is described in steps first, once a
repository. Every call answered is counted.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runweave.operators import prompts, ranks
from runweave.operators.merge import consensus, pass_orders
from runweave.session import materialize

CLASSES = ("blocking", "recommended", "skip")
NAMES = ("test_path", "classification", "confidence", "reasoning")
DECISION = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType() if n == "confidence" else T.StringType()) for n in NAMES]))


def parse_decisions(raw: str | None) -> list[tuple] | None:
    """The decisions of an answer, or None if any of it isn't as agreed: all or nothing. An empty list is an answer."""
    try:
        body = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(body, dict) or not isinstance(body.get("decisions"), list):
        return None
    out = []
    for d in body["decisions"]:
        number = d.get("confidence") if isinstance(d, dict) else None
        if not isinstance(d, dict) or not isinstance(d.get("test_path"), str) or d.get("classification") not in CLASSES or isinstance(number, bool) or not isinstance(number, (int, float)) or not isinstance(d.get("reasoning"), str):
            return None
        out.append((d["test_path"], d["classification"], float(number), d["reasoning"]))
    return out


@F.pandas_udf(DECISION)
def decisions_of(raw: pd.Series) -> pd.Series:
    """Column form of ``parse_decisions``."""
    return raw.map(lambda r: None if (p := parse_decisions(r)) is None else [dict(zip(NAMES, d)) for d in p])


def classify(candidates: DataFrame, answer: Callable[[list[str]], str | None], *, batch: int = 64) -> DataFrame:
    """repo_id, test_path, classification, confidence, reasoning from a classifier called on batches of consecutive paths of a repository.

    An unusable answer is asked for once more; if that fails too, the batch has no rows.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for repo, asked in zip(part["repo_id"], part["paths"]):
                paths = list(asked)
                found = parse_decisions(answer(paths))
                found = parse_decisions(answer(paths)) if found is None else found
                if found:
                    frame = pd.DataFrame(found, columns=list(NAMES))
                    frame.insert(0, "repo_id", repo)
                    yield frame

    return in_batches(candidates, batch).select("repo_id", "paths").mapInPandas(run, "repo_id string, test_path string, classification string, confidence double, reasoning string")


def rule_answer(paths: list[str]) -> str:
    """An offline stand-in for a model: end-to-end tests block, unit tests may be skipped, others are recommended."""
    kind = lambda p: "blocking" if "e2e" in p else "skip" if "unit" in p else "recommended"
    return json.dumps({"decisions": [{"test_path": p, "classification": kind(p), "confidence": 0.5, "reasoning": "by folder"} for p in paths]})


Provider = Callable[[str, str], tuple[str, int] | None]
_log = logging.getLogger(__name__)


def first_of(*providers: Provider) -> Provider:
    """A provider that asks one after the other until one answers; failures are logged. None if none does."""

    def ask(system: str, question: str) -> tuple[str, int] | None:
        for provider in providers:
            try:
                found = provider(system, question)
            except Exception as e:  # noqa: BLE001 - the next one is asked
                _log.warning("a provider failed: %s", e)
                continue
            if found is not None:
                return found
        return None

    return ask


def rule_provider(system: str, question: str) -> tuple[str, int] | None:
    """The offline stand-in as a provider; a token is a word."""
    paths = question.partition("Tests:\n")[2].partition("\n\n")[0].split("\n") if "Tests:\n" in question else []
    answer = rule_answer(paths) if paths else "unknown"
    return answer, len(question.split()) + len(answer.split())


def in_batches(candidates: DataFrame, size: int = 64) -> DataFrame:
    """repo_id, batch, paths: the candidates of each repository in order, cut into arrays of ``size``."""
    rows = ranks.placed(candidates.select("repo_id", "test_path").distinct(), ["repo_id"], [F.col("test_path")])
    return rows.groupBy("repo_id", F.floor((F.col("place") - 1) / size).cast("int").alias("batch")).agg(F.array_sort(F.collect_list("test_path")).alias("paths"))


def described(changes: DataFrame, provider: Provider) -> DataFrame:
    """repo_id, diff, notes, calls, tokens of changes(repo_id, diff, notes): a large diff's notes begin with what the steps found out about it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            notes, calls, tokens = [], [], []
            for diff, note, large in zip(part["diff"], part["notes"], part["large"]):
                context, n, t = prompts.step_context(diff, lambda q: first_of(provider)("Answer briefly.", q)) if large else ("", 0, 0)
                notes.append("\n".join(x for x in (context, (note or "").strip()) if x))
                calls.append(n)
                tokens.append(t)
            yield pd.DataFrame({"repo_id": part["repo_id"], "diff": part["diff"], "notes": notes, "calls": calls, "tokens": tokens})

    rows = changes.select("repo_id", "diff", "notes", prompts.in_steps("diff").alias("large"))
    return rows.mapInPandas(run, "repo_id string, diff string, notes string, calls bigint, tokens bigint")


def classify_changes(candidates: DataFrame, changes: DataFrame, provider: Provider, careful: DataFrame | None = None, *, size: int = 64) -> tuple[DataFrame, DataFrame]:
    """(repo_id, test_path, classification, confidence, reasoning; repo_id, calls, tokens, fallback_used).

    candidates(repo_id, test_path), changes(repo_id, diff, notes), careful(repo_id): repositories asked in three passes of different order, of
    which the most cautious decision of a test counts. An unusable answer is asked for once more with its beginning; a batch without a usable
    answer has no decisions, and a repository without any used the fallback.
    """
    known = materialize(described(changes, provider), "changes")
    asked = in_batches(candidates, size).join(known.select("repo_id", "diff", "notes"), "repo_id")
    orders = list(pass_orders("paths").values())
    strict = asked.select("repo_id").distinct() if careful is None else careful.select("repo_id").distinct()
    strict = strict.withColumn("_strict", F.lit(careful is not None))
    passes = F.when(F.coalesce("_strict", F.lit(False)), F.array(*orders)).otherwise(F.array(orders[0]))
    rows = asked.join(strict, "repo_id", "left").select("repo_id", "batch", "diff", "notes", F.posexplode(passes).alias("pass", "order"))
    rows = rows.select("repo_id", "batch", "pass", prompts.prompt("order", "diff", "notes", ordered=False).alias("question"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = first_of(provider)
        for part in parts:
            found, calls, tokens = [], [], []
            for question in part["question"]:
                n = t = 0
                answer = decided = None
                for text in (lambda: question, lambda: question + prompts.AGAIN + (answer[0] if answer else "")[: prompts.ANSWER_SHOWN]):
                    answer = ask(prompts.SYSTEM, text())
                    if answer is not None:
                        n, t = n + 1, t + answer[1]
                        decided = parse_decisions(answer[0])
                    if decided is not None:
                        break
                found.append(None if decided is None else [dict(zip(NAMES, d)) for d in decided])
                calls.append(n)
                tokens.append(t)
            yield part[["repo_id", "batch", "pass"]].assign(decisions=found, calls=calls, tokens=tokens)

    schema = T.StructType([T.StructField("repo_id", T.StringType()), T.StructField("batch", T.IntegerType()), T.StructField("pass", T.IntegerType()), T.StructField("decisions", DECISION), T.StructField("calls", T.LongType()), T.StructField("tokens", T.LongType())])
    answers = materialize(rows.mapInPandas(run, schema), "answers")
    each = answers.select("repo_id", "pass", F.posexplode("decisions").alias("position", "d")).select("repo_id", "pass", "position", "d.*")
    used = answers.select("repo_id", "calls", "tokens", F.col("decisions").isNotNull().alias("ok")).unionByName(known.select("repo_id", "calls", "tokens", F.lit(None).cast("boolean").alias("ok")))
    usage = used.groupBy("repo_id").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), (~F.coalesce(F.bool_or("ok"), F.count("ok") == 0)).alias("fallback_used"))
    return consensus(each, ("confidence", "reasoning")), usage
