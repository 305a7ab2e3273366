"""Benchmark setups: a tab-separated text whose every line is checked, with errors that name file and line."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the setup format.
REQUIRED = ("dataset", "json_output", "csv_output", "reference")
DIAGNOSTICS = ("none", "selected_distances", "full_distance_table")
POLICIES = ("sequential", "cpu_parallel", "gpu_fp32", "gpu_cublas_fp32", "load")
INDEXES = ("exact", "flat", "uniform", "hierarchical")
FILES = {"reference_vectors_file": "reference_vectors.npy", "reference_labels_file": "reference_labels.npy", "queries_file": "queries.npy", "query_labels_file": "query_labels.npy"}
CPU_L2 = ("sequential", "parallel_queries", "parallel_reference_vectors", "automatic")
RUN_KEYS = ("backend", "strategy", "batch_sizes", "warmups", "trials", "repetitions", "seed", "projection_dimension")

#: How the named strategies and policies are carried out here.
SPARK_STRATEGY = {"sequential": "array_scan", "parallel_queries": "array_scan", "parallel_reference_vectors": "parallel_references", "automatic": "automatic", "direct": "direct", "gemm": "gemm"}
SPARK_POLICY = {"sequential": "relational", "cpu_parallel": "blocked", "gpu_fp32": "blocked", "gpu_cublas_fp32": "gram"}


class SetupError(ValueError):
    """A setup that can't be used; the message begins with file and line."""


@dataclass(frozen=True)
class Run:
    name: str
    index: str
    backend: str
    strategy: str
    batch_sizes: tuple[int, ...]
    warmups: int
    trials: int
    repetitions: int | None = None
    seed: int | None = None
    projection_dimension: int | None = None


@dataclass(frozen=True)
class Setup:
    dataset: str
    json_output: str
    csv_output: str
    reference: str
    distance: str = "l2"
    max_queries: int = 0
    warmups: int = 1
    trials: int = 3
    batch_sizes: tuple[int, ...] = (1,)
    device: int = 0
    diagnostics: str = "none"
    probability_policy: str = "cpu_parallel"
    probabilities: str | None = None
    files: dict[str, str] = field(default_factory=dict)
    runs: tuple[Run, ...] = ()

    def ordered(self) -> list[Run]:
        """The reference run, then the others as they come."""
        return [r for r in self.runs if r.name == self.reference] + [r for r in self.runs if r.name != self.reference]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The runs as a table."""
        rows = [(r.name, r.index, r.backend, r.strategy, list(r.batch_sizes), r.warmups, r.trials, r.repetitions, r.seed, r.projection_dimension) for r in self.runs]
        return spark.createDataFrame(rows, "name string, index string, backend string, strategy string, batch_sizes array<int>, warmups int, trials int, repetitions int, seed bigint, projection_dimension int")


def _whole(text: str, least: int, what: str) -> int:
    if not re.fullmatch(r"\d+", text) or int(text) < least:
        raise ValueError(f"{what} must be a whole number of at least {least}, not {text!r}")
    return int(text)


def _sizes(text: str) -> tuple[int, ...]:
    return tuple(_whole(x, 1, "a batch size") for x in text.split(","))


def _one_of(text: str, choices: tuple[str, ...], what: str) -> str:
    if text not in choices:
        raise ValueError(f"{what} must be one of {', '.join(choices)}, not {text!r}")
    return text


def strategies(backend: str, distance: str, index: str) -> tuple[str, ...]:
    """What a run may ask for; the first is the default."""
    if backend == "cuda":
        if distance == "l2":
            return "gemm", "direct"
        return ("direct", "gemm") if index == "hierarchical" else ("direct",)
    return CPU_L2 if distance == "l2" and index != "hierarchical" else ("sequential",)


def parse(text: str, source: str = "setup") -> Setup:
    """Reads a setup; relative paths are taken from the folder of ``source``."""
    base, globals_, runs, started = os.path.dirname(source), {}, [], False
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        try:
            if not started:
                if not re.fullmatch(r"\w*benchmark_setup_v2", line.strip()):
                    raise ValueError("the first line must name version two of the setup format")
                started = True
                continue
            key, *rest = line.split("\t")
            if key == "run":
                runs.append((number, _run_fields(rest)))
            elif len(rest) != 1 or not rest[0]:
                raise ValueError(f"{key!r} takes one value")
            elif key in globals_:
                raise ValueError(f"{key!r} comes twice")
            else:
                globals_[key] = _global(key, rest[0], base)
        except ValueError as bad:
            raise SetupError(f"{source}:{number}: {bad}") from None
    try:
        return _finished(globals_, runs, source)
    except SetupError:
        raise
    except ValueError as bad:
        raise SetupError(f"{source}: {bad}") from None


def _global(key: str, value: str, base: str):
    if key in ("dataset", "json_output", "csv_output", "probabilities"):
        return os.path.normpath(os.path.join(base, value))
    if key in FILES or key == "reference":
        return value
    if key in ("max_queries", "warmups", "device"):
        return _whole(value, 0, key)
    if key == "trials":
        return _whole(value, 1, key)
    if key == "batch_sizes":
        return _sizes(value)
    choices = {"distance": ("l1", "l2"), "diagnostics": DIAGNOSTICS, "probability_policy": POLICIES}
    if key in choices:
        return _one_of(value, choices[key], key)
    raise ValueError(f"unknown directive {key!r}")


def _run_fields(rest: list[str]) -> dict[str, str]:
    if len(rest) < 2 or not rest[0]:
        raise ValueError("a run needs a name and an index")
    out = {"name": rest[0], "index": _one_of(rest[1], INDEXES, "index")}
    for part in rest[2:]:
        key, equal, value = part.partition("=")
        if not equal or not value or key not in RUN_KEYS:
            raise ValueError(f"unknown run parameter {part!r}")
        if key in out:
            raise ValueError(f"{key!r} comes twice")
        out[key] = value
    return out


def _finished(globals_: dict, runs: list, source: str) -> Setup:
    for key in REQUIRED:
        if key not in globals_:
            raise ValueError(f"{key!r} is missing")
    if "probabilities" in globals_ and "probability_policy" not in globals_:
        globals_["probability_policy"] = "load"
    if (globals_.get("probability_policy") == "load") != ("probabilities" in globals_):
        raise ValueError("the load policy and a probabilities path go together")
    files = {k: globals_.pop(k, v) for k, v in FILES.items()}
    setup = Setup(**globals_, files=files)
    if setup.distance == "l1" and setup.probability_policy == "gpu_cublas_fp32":
        raise ValueError("l1 has no matrix product form")
    done: list[Run] = []
    for number, fields in runs:
        try:
            done.append(_run(fields, setup))
            if any(r.name == done[-1].name for r in done[:-1]):
                raise ValueError(f"two runs are named {done[-1].name!r}")
        except ValueError as bad:
            raise SetupError(f"{source}:{number}: {bad}") from None
    reference = [r for r in done if r.name == setup.reference]
    if not reference or reference[0].index != "exact":
        raise ValueError("the reference must be an exact run")
    return Setup(**{**setup.__dict__, "runs": tuple(done)})


def _run(f: dict[str, str], setup: Setup) -> Run:
    index, backend = f["index"], _one_of(f.get("backend", "cpu"), ("cpu", "cuda"), "backend")
    allowed = strategies(backend, setup.distance, index)
    strategy = f.get("strategy", allowed[0])
    if strategy not in allowed:
        raise ValueError(f"{backend} {setup.distance} {index} does not support {strategy!r}")
    needed = {"exact": (), "hierarchical": ("repetitions", "seed", "projection_dimension")}.get(index, ("repetitions", "seed"))
    numbers: dict[str, int | None] = {}
    for key, least in (("repetitions", 1), ("seed", 0), ("projection_dimension", 1)):
        if (key in f) != (key in needed):
            raise ValueError(f"{index} runs {'need' if key in needed else 'take no'} {key}")
        numbers[key] = _whole(f[key], least, key) if key in f else None
    sizes = _sizes(f["batch_sizes"]) if "batch_sizes" in f else setup.batch_sizes
    warmups = _whole(f["warmups"], 0, "warmups") if "warmups" in f else setup.warmups
    trials = _whole(f["trials"], 1, "trials") if "trials" in f else setup.trials
    return Run(f["name"], index, backend, strategy, sizes, warmups, trials, **numbers)


def load(path: str) -> Setup:
    with open(path, encoding="utf-8") as file:
        return parse(file.read(), path)
