"""Programs and models as row functions: child processes, a model gateway with limits and accounting."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT_S = 300


def run_process(argv: Sequence[str], payload: dict, timeout: float = TIMEOUT_S, env: dict[str, str] | None = None) -> dict:
    """One JSON object to a program's input, one from its output. The program gets only the given environment and is killed
    after the timeout; every failure comes back as {"error": …}."""
    try:
        done = subprocess.run(list(argv), input=json.dumps(payload), capture_output=True, text=True, timeout=timeout, env=env or {"PATH": "/usr/bin:/bin"})
    except subprocess.TimeoutExpired:
        return {"error": f"timed out after {timeout:g} s"}
    except OSError as e:
        return {"error": f"could not start: {e.strerror}"}
    if done.returncode:
        return {"error": f"exited {done.returncode}: {done.stderr.strip()[-300:]}"}
    try:
        reply = json.loads(done.stdout)
    except ValueError:
        return {"error": f"no JSON: {done.stdout.strip()[:300]}"}
    return reply if isinstance(reply, dict) else {"error": "no JSON object"}


def process_system(cases: DataFrame, argv: Sequence[str], timeout: float = TIMEOUT_S) -> DataFrame:
    """id, output, error: a program run once per case on the case's JSON."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies = [run_process(argv, json.loads(c), timeout) for c in f["case"]]
            yield pd.DataFrame({"id": f["id"], "output": [str(r.get("output") or "") for r in replies], "error": [r.get("error") for r in replies]})

    body = F.to_json(F.struct(*[c for c in cases.columns]))
    return cases.select("id", body.alias("case")).mapInPandas(run, "id string, output string, error string")


def docker_argv(image: str, name: str, entry: str, env: dict[str, str], network: str = "bench") -> list[str]:
    """The command line of a container that reads standard input and is removed when it ends."""
    out = ["docker", "run", "--rm", "-i", "--name", name, "--network", network]
    for k, v in sorted(env.items()):
        out += ["-e", f"{k}={v}"]
    return [*out, image, "node", entry]


class LimitReached(RuntimeError):
    pass


class Gateway:
    """A model behind an allow-list and a limit of calls, with its use counted and its prompts logged; one per task and run.

    count: text -> tokens; price: (tokens in, tokens out) -> cost or None where the provider reports none.
    """

    def __init__(self, models: dict[str, Callable[[str], str]], max_calls: int, count: Callable[[str], int] = lambda t: len(t.split()), price: Callable[[int, int], float | None] = lambda i, o: None):
        self.models, self.max_calls, self.count, self.price = models, max_calls, count, price
        self.calls = self.tokens_in = self.tokens_out = 0
        self.cost: float | None = None
        self.used: list[str] = []
        self.requests: list[str] = []

    def ask(self, model: str, prompt: str) -> str:
        if model not in self.models:
            raise PermissionError(f"model {model} is not allowed")
        if self.calls >= self.max_calls:
            raise LimitReached(f"more than {self.max_calls} calls")
        self.calls += 1
        self.requests.append(prompt)
        reply = self.models[model](prompt)
        i, o = self.count(prompt), self.count(reply)
        self.tokens_in, self.tokens_out = self.tokens_in + i, self.tokens_out + o
        cost = self.price(i, o)
        if cost is not None:
            self.cost = (self.cost or 0.0) + cost
        if model not in self.used:
            self.used.append(model)
        return reply

    def usage(self) -> dict:
        return {"modelCalls": self.calls, "tokensIn": self.tokens_in, "tokensOut": self.tokens_out, "costUsd": self.cost, "models": self.used}
