"""Command line: run or validate a setup, compute probabilities, the synthetic quickstart, a sweep over setups."""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import SparkSession

from nearfield.operators import datasets, sampling
from nearfield.plans import runner, setup
from nearfield.sources import storage


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m nearfield.plans.cli", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("--setup", required=True)
    run.add_argument("--validate-only", action="store_true")
    probs = commands.add_parser("probabilities")
    probs.add_argument("--input", required=True, help="NPY matrix of references")
    probs.add_argument("--output", required=True)
    probs.add_argument("--metric", choices=("l1", "l2"), default="l2")
    probs.add_argument("--policy", choices=sampling.POLICIES, default="blocked")
    quick = commands.add_parser("quickstart")
    quick.add_argument("--output", required=True)
    for name, value in (("references", 64), ("queries", 512), ("dimensions", 16_384), ("informative", 2_048), ("seed", 2026)):
        quick.add_argument(f"--{name}", type=int, default=value)
    sweep = commands.add_parser("sweep")
    sweep.add_argument("--setup", required=True, nargs="+")
    sweep.add_argument("--force", action="store_true")
    sweep.add_argument("--dry-run", action="store_true")
    options = parser.parse_args(arguments)
    return {"run": _run, "probabilities": _probabilities, "quickstart": _quickstart, "sweep": _sweep}[options.command](options)


def _spark() -> SparkSession:
    return SparkSession.builder.appName("nearfield").getOrCreate()


def _report(wanted: setup.Setup) -> dict:
    refs, queries = storage.read_dataset(_spark(), wanted.dataset, wanted.files, both_or_none=True)
    report = runner.validated(runner.run(wanted, refs, queries))
    runner.write_report(report, wanted.json_output, wanted.csv_output)
    return report


def _show(report: dict) -> None:
    for r in report["runs"]:
        for m in r["measurements"]:
            print(f"{r['name']}\tbatch {m['batch_size']}\t{m['us_per_query']:.1f} us a query\t{r['quality']['agreeing']} of {r['quality']['queries']} agree")


def _run(options) -> int:
    wanted = setup.load(options.setup)
    if options.validate_only:
        print(f"{options.setup}: {len(wanted.runs)} runs, reference {wanted.reference}")
        return 0
    _show(_report(wanted))
    return 0


def _sweep(options) -> int:
    """Runs each setup whose report is not there yet (or all, by force)."""
    for path in options.setup:
        wanted = setup.load(path)
        if os.path.exists(wanted.json_output) and not options.force:
            with open(wanted.json_output, encoding="utf-8") as file:
                _show(runner.validated(json.load(file)))
        elif options.dry_run:
            print(f"would run {path}")
        else:
            _show(_report(wanted))
    return 0


def _probabilities(options) -> int:
    began = time.perf_counter()
    refs = storage.read_matrix(_spark(), options.input)
    rows, sha = refs.count(), storage.sha256_file(options.input)
    if rows < 2:
        raise SystemExit("two references at least are needed")
    found = sampling.importance_probabilities(refs, options.metric, options.policy).orderBy("j").collect()
    storage.write_probability_file(options.output, options.metric, rows, sha, [r.prob for r in found])
    print(f"reference_vectors\t{rows}\nreference_vectors_sha256\t{sha}\ntotal_ms\t{(time.perf_counter() - began) * 1000:.0f}")
    return 0


def _quickstart(options) -> int:
    """Generates a dataset, runs exact, flat, uniform and hierarchical indexes over it and writes the report."""
    refs, queries = datasets.synthetic(_spark(), options.references, options.queries, options.dimensions, options.informative, seed=options.seed)
    folder = os.path.abspath(options.output)
    lines = ["benchmark_setup_v2", "dataset\tdata", "json_output\treport.json", "csv_output\ttrials.csv", "reference\texact", f"batch_sizes\t{options.queries}", "trials\t1", "probability_policy\tcpu_parallel", "diagnostics\tselected_distances", "run\texact\texact"]
    for t in (8, 32, 128):
        lines += [f"run\tflat_{t}\tflat\trepetitions={t}\tseed=42", f"run\tuniform_{t}\tuniform\trepetitions={t}\tseed=42"]
    lines.append("run\thierarchical_32\thierarchical\trepetitions=32\tseed=42\tprojection_dimension=64")
    wanted = setup.parse("\n".join(lines), os.path.join(folder, "setup.tsv"))
    report = runner.run(wanted, refs, queries)
    runner.write_report(report, wanted.json_output, wanted.csv_output)
    _show(report)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
