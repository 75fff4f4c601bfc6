"""External scorers: any model as a Python object, each distinct input scored once."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.storage import ship


class Scorer(Protocol):
    """Made once a task; ``score`` takes and returns a batch."""

    def score(self, inputs: list[str], species: list[str]) -> list[list[float]]: ...


class HashScorer:
    """A deterministic stand-in for a model: numbers from a digest of the input."""

    def __init__(self, width: int = 4):
        self.width = width

    def score(self, inputs: list[str], species: list[str]) -> list[list[float]]:
        out = []
        for x, s in zip(inputs, species, strict=True):
            digest = hashlib.sha256(f"{s}\n{x}".encode()).digest()
            out.append([b / 255 for b in digest[: self.width]])
        return out


def score_rows(df: DataFrame, text: str, species: str, make_scorer, out: str = "scores", batch: int = 64) -> DataFrame:
    """``df`` with an array of scores; equal (input, species) pairs are scored once and joined back.

    A null input has null scores.  Keys of the join are 128-bit hashes, not the inputs.
    """
    keys = [F.xxhash64(F.col(species), F.col(text)).alias("__h1"), F.xxhash64(F.lit(1), F.col(species), F.col(text)).alias("__h2")]
    ship(df.sparkSession)
    named = df.select("*", *keys)
    jobs = named.filter(F.col(text).isNotNull()).select("__h1", "__h2", F.col(text).alias("x"), F.col(species).cast("string").alias("s")).dropDuplicates(["__h1", "__h2"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            scores: list = []
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                scores += scorer.score(part["x"].tolist(), part["s"].tolist())
            yield pd.DataFrame({"__h1": pdf["__h1"], "__h2": pdf["__h2"], out: scores})

    scored = jobs.mapInPandas(run, f"__h1 long, __h2 long, {out} array<double>")
    return named.join(scored, ["__h1", "__h2"], "left").withColumn(out, F.when(F.col(text).isNotNull(), F.col(out))).drop("__h1", "__h2")


def judge_rows(df: DataFrame, key: str, prompt: str, make_client, retries: int = 3, wait: float = 0.0, threads: int = 1) -> DataFrame:
    """``key, reply, attempts, error``: one call a row with retries; the client is made once a task.

    ``wait``: seconds before the second attempt, doubled before each further one; ``threads``
    calls of a task run side by side (the client must allow it).
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def ask(pair: tuple) -> tuple:
            k, p = pair
            error = None
            for attempt in range(1, retries + 1):
                try:
                    return k, client(p), attempt, None
                except Exception as e:  # noqa: BLE001  the client's failures are data
                    error = str(e)
                if wait and attempt < retries:
                    time.sleep(wait * 2 ** (attempt - 1))
            return k, None, retries, error

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                yield pd.DataFrame(list(pool.map(ask, zip(pdf[key], pdf[prompt], strict=True))), columns=[key, "reply", "attempts", "error"])

    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, reply string, attempts int, error string")
