"""Steps that need a language model, as functions that a caller injects.

Each hook maps a list of requests to a list of answers; the default answers
nothing, so that what depends on a model stays undecided.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Hook = Callable[[list[str]], list[str | None]]


def no_answer(requests: list[str]) -> list[str | None]:
    return [None] * len(requests)


def one_by_one(hook: Hook, requests: list[str]) -> list[str | None]:
    """The hook's answers; where it fails on all of them together, each is asked alone, and null stands for those that fail."""
    try:
        found = list(hook(requests))
        if len(found) == len(requests):
            return found
    except Exception:  # which request failed is found out below
        pass
    out: list[str | None] = []
    for r in requests:
        try:
            (answer,) = hook([r])
        except Exception:  # a request that fails must not stop the others
            answer = None
        out.append(answer)
    return out


def first_of(*hooks: Hook) -> Hook:
    """A hook that asks the next one where those before it failed or gave no answer."""

    def run(requests: list[str]) -> list[str | None]:
        out = no_answer(requests)
        for hook in hooks:
            todo = [i for i, x in enumerate(out) if x is None]
            for i, x in zip(todo, one_by_one(hook, [requests[i] for i in todo]) if todo else [], strict=True):
                out[i] = x
        return out

    return run


def ask(df: DataFrame, request: str, answer: str, hook: Hook = no_answer) -> DataFrame:
    """Add a hook's answers to distinct requests; equal requests are asked once. A request that fails has null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{answer: one_by_one(hook, pdf[request].tolist())})

    once = df.select(request).where(F.col(request).isNotNull()).distinct()
    answers = once.mapInPandas(run, f"`{request}` string, `{answer}` string")
    return df.join(answers, request, "left")


def answer_queries(df: DataFrame, hook: Hook, retries: int = 1) -> DataFrame:
    """``query`` for each ``claim``; those without one are asked again with what went wrong."""
    out = ask(df, "claim", "query", hook)
    for _ in range(retries):
        again = ask(out.where("query is null").drop("query").withColumn("retry", F.concat("claim", F.lit("\nno query was given"))), "retry", "query", hook).drop("retry")
        out = out.where("query is not null").unionByName(again)
    return out
