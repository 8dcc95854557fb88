"""Processors: functions from DataFrames to DataFrames, registered under their import path, and pipelines of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

_REGISTERED: dict[str, Processor] = {}


@dataclass(frozen=True)
class Processor:
    """process(inputs by port, **config) -> outputs by port."""

    name: str
    process: Callable
    inputs: dict[str, str]
    outputs: tuple[str, ...]
    execution: str
    description: str = ""


def execution_of(inputs: dict, execution: str | None, interval_ms: int = 0) -> str:
    """Reactive where there are inputs and nothing is said; without inputs it must be said; intervals are not negative."""
    if interval_ms < 0:
        raise ValueError("the interval of a continuous processor is negative")
    if execution is None:
        if not inputs:
            raise ValueError("a processor without inputs must name its execution")
        return "reactive"
    if execution not in ("reactive", "continuous", "manual"):
        raise ValueError(f"unknown execution {execution!r}")
    return execution


def processor(inputs: dict[str, str] | None = None, outputs: tuple[str, ...] = (), execution: str | None = None, interval_ms: int = 0, description: str = ""):
    """Register a function as a processor. inputs: port -> delivery profile."""

    def add(f: Callable) -> Processor:
        name = f"{f.__module__}:{f.__qualname__}"
        if name in _REGISTERED:
            raise ValueError(f"{name} is registered already")
        for profile in (inputs or {}).values():
            if profile not in ("latest", "every_sample", "lossless"):
                raise ValueError(f"unknown delivery profile {profile!r}")
        _REGISTERED[name] = Processor(name, f, dict(inputs or {}), tuple(outputs), execution_of(inputs or {}, execution, interval_ms), description)
        return _REGISTERED[name]

    return add


def registered(spark: SparkSession) -> DataFrame:
    """The registry as a table."""
    rows = [(p.name, p.execution, p.inputs, list(p.outputs), p.description) for p in _REGISTERED.values()]
    return spark.createDataFrame(rows, "name string, execution string, inputs map<string,string>, outputs array<string>, description string")


@dataclass
class Pipeline:
    """Processors under aliases, joined by links; `run` folds them into DataFrames. Nothing runs before an action."""

    nodes: dict[str, tuple[Processor, dict]] = field(default_factory=dict)
    links: list[tuple[str, str, str, str]] = field(default_factory=list)

    def add(self, alias: str, p: Processor, **config) -> str:
        if alias in self.nodes:
            raise ValueError(f"alias {alias} is taken")
        self.nodes[alias] = (p, config)
        return alias

    def connect(self, source: str, target: str) -> None:
        """`alias.port` to `alias.port`."""
        ends = []
        for ref, out in ((source, True), (target, False)):
            alias, dot, port = ref.partition(".")
            if not dot:
                raise ValueError(f"{ref} has no port")
            if alias not in self.nodes:
                raise ValueError(f"unknown alias {alias}")
            p = self.nodes[alias][0]
            if port not in (p.outputs if out else p.inputs):
                raise ValueError(f"{alias} has no {'output' if out else 'input'} {port}")
            ends += [alias, port]
        self.links.append(tuple(ends))

    def run(self) -> dict[str, DataFrame]:
        """Every output as `alias.port`; several links into one input are one stream, profiles apply at inputs."""
        from ..operators.delivery import apply_profile
        from ..operators.pairing import fan_in

        order = TopologicalSorter({a: set() for a in self.nodes})
        for s, _, t, _ in self.links:
            order.add(t, s)
        try:
            ordered = list(order.static_order())
        except CycleError as e:
            raise ValueError(f"the links make a cycle: {e.args[1]}") from None
        out: dict[str, DataFrame] = {}
        for alias in ordered:
            p, config = self.nodes[alias]
            given = {}
            for port, profile in p.inputs.items():
                streams = [out[f"{s}.{sp}"] for s, sp, t, tp in self.links if (t, tp) == (alias, port)]
                if streams:
                    given[port] = apply_profile(fan_in(*streams), profile)
            for port, df in (p.process(given, **config) or {}).items():
                out[f"{alias}.{port}"] = df
        return out
