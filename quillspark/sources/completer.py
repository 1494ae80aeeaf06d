"""The completion connector: prompts go to a pluggable completer, batch by batch, on the executors.

A completer is a picklable function from a list of prompts to a list of texts of the same
length and order. One that raises gives empty texts for that batch, and the job goes on.
The default is an offline stub that depends on the prompt alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

Completer = Callable[[list[str]], list[str]]


def echo(prompts: list[str]) -> list[str]:
    """Offline stub: the facts that a prompt lists, as a note, under a name made from the prompt."""
    out = []
    for p in prompts:
        facts = [line[2:] for line in p.splitlines() if line.startswith("- ") and ": " in line]
        out.append(f"Note {hashlib.sha256(p.encode()).hexdigest()[:8]}. " + ". ".join(f.split(": ", 1)[1] for f in facts) + ".")
    return out


def empty_json(prompts: list[str]) -> list[str]:
    """Offline stub for extraction: an empty record."""
    return ["{}" for _ in prompts]


BACKENDS: dict[str, Completer] = {"echo": echo, "empty": empty_json}


def build(name: str = "echo") -> Completer:
    if name not in BACKENDS:
        raise ValueError(f"unknown completion backend {name!r}; there are {sorted(BACKENDS)}")
    return BACKENDS[name]


def preflight(completer: Completer, prompts: tuple[str, ...] = ("Reply with one word.", "Reply with {}.")) -> None:
    """Fails early, and says why, where a completer doesn't answer each prompt with a text."""
    for p in prompts:
        try:
            found = completer([p])
        except Exception as e:
            raise RuntimeError(f"the completer failed on {p!r}: {e}") from e
        if len(found) != 1 or not isinstance(found[0], str):
            raise RuntimeError(f"the completer must give one text for {p!r}, but gave {found!r}")


def complete(df: DataFrame, completer: Completer, prompt: str = "prompt", out: str = "completion", batch_size: int = 512) -> DataFrame:
    """df with a column of completions, in place."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), batch_size):
                part = batch.iloc[lo : lo + batch_size].copy()
                prompts = part[prompt].fillna("").tolist()
                try:
                    texts = completer(prompts)
                    if len(texts) != len(prompts):
                        raise ValueError("a completer must return one text per prompt")
                except Exception:
                    texts = [_alone(completer, p) for p in prompts]
                part[out] = texts
                yield part

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string")


def _alone(completer: Completer, prompt: str) -> str:
    try:
        return pd.Series(completer([prompt])).iloc[0]
    except Exception:
        return ""
