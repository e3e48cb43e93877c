"""python -m latelens.cli inspect|prepare|simulate|evaluate|compare|report ...; exit codes are those of errors."""

from __future__ import annotations

import argparse
import json
import sys

from latelens import api
from latelens.errors import EngineError
from latelens.plans.config import DataConfig, RunConfig, parsed, read


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("latelens").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="latelens")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"inspect": ["config"], "prepare": ["config", "out"], "simulate": ["config"], "evaluate": ["input"], "compare": ["control", "candidate"], "report": ["input"]}.items():
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
    sub.choices["compare"].add_argument("--replicates", type=int, default=2000)
    sub.choices["report"].add_argument("--format", choices=("html", "json", "text"), default="html")
    return p


def run(argv: list[str]) -> str:
    a, spark = _parser().parse_args(argv), _spark()
    from latelens.sources import readers

    if a.command in ("inspect", "prepare"):
        got = api.inspect(spark, read(DataConfig, a.config))
        if a.command == "prepare":
            got = api.prepare(spark, got["accepted"], a.out, got["profile"]["time_unit"])
            return json.dumps(got, default=str, sort_keys=True)
        return api.report({k: v for k, v in got.items() if k in ("fields", "reasons", "columns", "days", "horizon", "duplicates", "order")}, "json")
    if a.command == "simulate":
        out = api.simulate(readers.boundary_fixture(spark), parsed(RunConfig, json.load(open(a.config, encoding="utf-8"))))
        return api.report({"predictions": out["predictions"]}, "json")
    if a.command == "compare":
        both = [readers.read_evaluation(spark, x) for x in (a.control, a.candidate)]
        return json.dumps(api.compare(*both, replicates=a.replicates))
    got = api.evaluate(readers.read_evaluation(spark, a.input))
    tables = {k: v for k, v in got.items() if k != "calibration"}
    return api.report(tables, a.format if a.command == "report" else "json")


def main(argv: list[str] | None = None) -> int:
    try:
        print(run(sys.argv[1:] if argv is None else argv))
        return 0
    except EngineError as e:
        print(json.dumps(e.as_dict()), file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
