"""Models behind a gateway: who may ask what, how often, and what it took.

A gateway belongs to one run of one dataflow. It knows the model of every system and role, which models are allowed, and how
many calls a job may make; it logs every call, so a job's calls, tokens, cost, latency and requests are counted from what was
really asked. A job is a row of cases with a unique `id`; `routes` is a table of settings (systems and roles), looked up by
the job's system.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.session import cut_lineage

Model = Callable[[str], str]
#: Parts of a job's id: system, case, repetition.
SEPARATOR = "\x1f"


def job_id(system: Column, case_id: Column, repetition: Column) -> Column:
    return F.concat_ws(SEPARATOR, system, case_id, repetition.cast("string"))


def _part(i: int) -> Column:
    return F.get(F.split("id", SEPARATOR), i)


@dataclass
class Gateway:
    """ask: (model's name, prompt) -> reply. routes: system -> role -> model's name; a role without a route falls back to
    main, a system without any to `default`. allowed: names of models that may be asked, all if None. limits: system -> most
    calls a job may make, else `max_calls` (no limit if None). price: (model, tokens in, tokens out) -> cost or None."""

    ask: Callable[[str, str], str]
    routes: dict[str, dict[str, str]] = field(default_factory=dict)
    default: str = "scripted"
    allowed: frozenset[str] | None = None
    limits: dict[str, int] = field(default_factory=dict)
    max_calls: int | None = None
    price: Callable[[str, int, int], float | None] = lambda m, i, o: None
    log: list[DataFrame] = field(default_factory=list)

    def model_of(self, role: str) -> Column:
        """The name of the model that a job's system uses in a role."""
        named = {s: r.get(role) or r.get("main") or self.default for s, r in self.routes.items()}
        if not named:
            return F.lit(self.default)
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(named.items()) for x in kv]), _part(0)), F.lit(self.default))

    def _limit(self) -> Column | None:
        if not self.limits:
            return None if self.max_calls is None else F.lit(self.max_calls)
        own = F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(self.limits.items()) for x in kv]), _part(0))
        return F.coalesce(own, F.lit(self.max_calls)) if self.max_calls is not None else own

    def _checked(self, asked: DataFrame, keys: list[str]) -> DataFrame:
        """The questions with `__refused`, why one isn't passed on: the model isn't allowed or the job's calls are used up."""
        refused: Column = F.lit(None).cast("string")
        if self.allowed is not None:
            refused = F.when(~F.col("__model").isin(*self.allowed), F.concat(F.lit("PermissionError: model "), "__model", F.lit(" is not allowed")))
        limit = self._limit()
        if limit is not None:
            n = F.lit(1) if keys == ["id"] else F.row_number().over(Window.partitionBy("id").orderBy(*keys[1:]))
            asked = asked.withColumn("__n", n)
            if self.log:
                asked = asked.join(self._calls(), "id", "left").withColumn("__n", F.col("__n") + F.coalesce("__before", F.lit(0))).drop("__before")
            told = F.concat(F.lit("LimitReached: more than "), limit.cast("string"), F.lit(" calls"))
            refused = F.coalesce(refused, F.when(F.col("__n") > limit, told))
            asked = asked.withColumn("__refused", refused).drop("__n")
        else:
            asked = asked.withColumn("__refused", refused)
        return asked

    def _calls(self) -> DataFrame:
        return self._all().groupBy("id").agg(F.count("*").alias("__before"))

    def _all(self) -> DataFrame:
        out = self.log[0]
        for more in self.log[1:]:
            out = out.unionByName(more)
        return out

    def put(self, asked: DataFrame, keys: list[str], role: str, parallel: int) -> DataFrame:
        """keys, __reply (reasoning removed), __error: the answers to asked (keys, __prompt); written, so that a model isn't
        asked twice for a row, and logged. Up to `parallel` questions are open at once in each task."""
        ask, price = self.ask, self.price
        names = [*keys, "__model", "__prompt", "__reply", "__error", "tokens_in", "tokens_out", "cost", "ms"]

        def one(model: str, prompt: str, refused: object) -> tuple:
            if isinstance(refused, str):
                return None, refused, None, None, None, None
            began = time.monotonic()
            try:
                reply, error = re.sub(r"(?s)<think>.*?</think>", "", ask(model, prompt)).strip(), None
            except Exception as e:  # the failure is the row's, not the job's
                reply, error = None, f"{type(e).__name__}: {e}"
            i, o = len(prompt.split()), len((reply or "").split())
            return reply, error, i, o, price(model, i, o), int((time.monotonic() - began) * 1000)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(parallel) as pool:
                for f in frames:
                    got = list(zip(*pool.map(one, f["__model"], f["__prompt"], f["__refused"]))) or [()] * 6
                    out = f[[*keys, "__model", "__prompt"]].copy()
                    for name, values in zip(names[len(keys) + 2 :], got):
                        out[name] = pd.Series(list(values), index=out.index, dtype="object")
                    yield out[names]

        checked = self._checked(asked.withColumn("__model", self.model_of(role)), keys)
        kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
        schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "__model string, __prompt string, __reply string, __error string, tokens_in bigint, tokens_out bigint, cost double, ms bigint"])
        answered = cut_lineage(checked.mapInPandas(run, schema))
        made = answered.where("ms is not null").select("id", F.lit(len(self.log)).alias("phase"), F.array(*[F.col(k).cast("int") for k in keys[1:]]).cast("array<int>").alias("at"), F.col("__model").alias("model"), F.col("__prompt").alias("prompt"), "tokens_in", "tokens_out", "cost", "ms")
        self.log.append(made)
        return answered.select(*keys, "__reply", "__error")

    def usage(self, requests: bool = False) -> DataFrame | None:
        """Per job: model_calls, tokens_in, tokens_out, cost_usd (NULL if no call has a price), latency_ms of its calls, models
        and, if wanted, model_requests in the order of asking. None if nothing was asked."""
        if not self.log:
            return None
        sums = [F.count("*").cast("int").alias("model_calls"), *[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out")], F.sum("cost").alias("cost_usd"), F.sum("ms").alias("latency_ms"), F.array_sort(F.collect_set("model")).alias("models")]
        if requests:
            sums.append(F.transform(F.array_sort(F.collect_list(F.struct("phase", "at", "prompt"))), lambda x: x["prompt"]).alias("model_requests"))
        return self._all().groupBy("id").agg(*sums)


def plain(model: Model, **roles: Model) -> Gateway:
    """A gateway without limits around one function of prompts, or one for each role."""
    if not roles:
        return Gateway(lambda _, prompt: model(prompt))
    return Gateway(lambda name, prompt: roles.get(name, model)(prompt), routes={}, default="main")


def gateway_of(model: Model | Gateway) -> Gateway:
    return model if isinstance(model, Gateway) else plain(model)


def ask(df: DataFrame, keys: list[str], prompt: Column | str, reply: str, gate: Gateway, role: str = "main", texts: DataFrame | None = None, parallel: int = 8) -> DataFrame:
    """df with the model's `reply` and `<reply>_error`, asked through the gateway; NULL prompts are not asked.

    keys (id first) identify a row. Only keys and prompts go to the model, and only replies come back to df. texts: what the
    prompt needs besides df's columns, by id; so rows of sentences carry no documents.
    """
    wide = df if texts is None else df.join(texts, "id")
    asked = wide.select(*keys, (F.col(prompt) if isinstance(prompt, str) else prompt).alias("__prompt")).where("__prompt is not null")
    answered = gate.put(asked, keys, role, parallel)
    return df.join(answered.withColumnsRenamed({"__reply": reply, "__error": f"{reply}_error"}), keys, "left")
