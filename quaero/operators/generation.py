"""Resumable generation runs: a model over prompts, one record a prompt, failures recorded and not raised."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.operators.ranking import pending

RECORD = "run_id string, method string, query_id long, prompt string, answer string, status string, error struct<type:string,message:string>, latency_ms double"


def failure(error: BaseException) -> str:
    """The class of an error: exhausted memory, a missing quantization library, or its own name."""
    said = str(error).lower()
    if "out of memory" in said or ("cuda" in said and "memory" in said):
        return "cuda_oom"
    return "missing_bitsandbytes" if "bitsandbytes" in said else type(error).__name__


def echo(prompt: str) -> str:
    """A stand-in for a model: the prompt's first words."""
    return " ".join(prompt.split()[:8])


def generate(prompts: DataFrame, model=echo, run_id: str = "run", done: DataFrame | None = None) -> DataFrame:
    """Records of ``prompts`` (method, query_id, prompt) that ``done`` doesn't have, for the same run.

    A failed record counts as done.  ``model`` is made for each task if it has
    a ``load`` method, else called as it is.
    """
    wanted = prompts.withColumn("run_id", F.lit(run_id))
    if done is not None:
        wanted = pending(wanted, done, ["run_id", "method", "query_id"])

    def run(batches):
        call = model.load() if hasattr(model, "load") else model
        for pdf in batches:
            out = []
            for r, m, q, p in zip(pdf["run_id"], pdf["method"], pdf["query_id"], pdf["prompt"], strict=True):
                began = time.perf_counter()
                try:
                    answer, status, error = call(p), "ok", None
                except Exception as e:
                    answer, status, error = None, "error", {"type": failure(e), "message": str(e)}
                out.append((r, m, q, p, answer, status, error, (time.perf_counter() - began) * 1000))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])

    return wanted.select("run_id", "method", "query_id", "prompt").mapInPandas(run, RECORD)
