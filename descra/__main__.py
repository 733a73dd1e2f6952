"""validate SETTINGS | run SETTINGS [--output DIR] [--resume] [--techniques A,B] [--cv-mode nested|flat] [--enable-automl | --disable-automl] [--no-final-model] | resume SETTINGS"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from descra.plans import manifest


def main(argv: list[str] | None = None) -> int:
    """0: done, 1: a stage failed, 2: the settings are wrong."""
    p = argparse.ArgumentParser(prog="descra", description=__doc__)
    p.add_argument("command", choices=("validate", "run", "resume"))
    p.add_argument("settings")
    p.add_argument("--output")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--techniques")
    p.add_argument("--no-final-model", action="store_true")
    p.add_argument("--cv-mode", choices=manifest.CV)
    p.add_argument("--enable-automl", dest="automl", action="store_true", default=None)
    p.add_argument("--disable-automl", dest="automl", action="store_false")
    a = p.parse_args(argv)
    try:
        with open(a.settings) as f:
            m = manifest.load(f.read())
        if a.techniques:
            chosen = tuple(x.strip() for x in a.techniques.split(","))
            if unknown := [x for x in chosen if x not in manifest.TECHNIQUES]:
                raise manifest.ManifestError([f"unknown technique {x}" for x in unknown])
            m = replace(m, automl=replace(m.automl, techniques=chosen))
    except manifest.ManifestError as e:
        print(e, file=sys.stderr)
        return 2
    m = replace(m, run=replace(m.run, output=a.output or m.run.output, resume=a.resume or a.command == "resume" or m.run.resume))
    if a.cv_mode:
        m = replace(m, automl=replace(m.automl, cv=a.cv_mode))
    if a.automl is not None:
        m = replace(m, automl=replace(m.automl, enabled=a.automl))
    if a.no_final_model:
        m = replace(m, automl=replace(m.automl, final_model=False))
    print(" -> ".join(m.stages()), m.digest()[:12])
    if a.command == "validate":
        return 0
    from pyspark.sql import SparkSession

    from descra.plans.run import run

    return int(run(SparkSession.builder.appName("descra").getOrCreate(), m).failed())


if __name__ == "__main__":
    sys.exit(main())
