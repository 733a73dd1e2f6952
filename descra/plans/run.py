"""The stages of a run, each from written tables to written tables."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descra.operators import columns, crossval, descriptors, folds, joins, residues, selection, validate
from descra.plans.manifest import Manifest
from descra.sources import results, sinks, structures, tables, tools


@dataclass
class Log:
    """Events of a run: kept, and written as JSON lines, failures as a table and the state of the stages after each of them."""

    events: list[dict] = field(default_factory=list)

    def add(self, stage: str, event: str, **detail) -> None:
        self.events.append({"time": datetime.datetime.now(datetime.timezone.utc).isoformat(), "stage": stage, "event": event, **detail})

    def failed(self) -> bool:
        return any(e["event"] == "failed" for e in self.events)

    def write(self, spark: SparkSession, path: str, ended: bool = True) -> None:
        sinks.put_text(spark, f"{path}/events.jsonl", "".join(json.dumps(e, sort_keys=True) + "\n" for e in self.events))
        failed = [e for e in self.events if e["event"] == "failed"]
        of = lambda e: "; ".join(f"{k}={v}" for k, v in e.items() if k not in ("time", "stage", "event", "reason"))
        plain = lambda v: " ".join(str(v).split())
        sinks.put_text(spark, f"{path}/failures.tsv", "time\tstage\tof\treason\n" + "".join(f"{e['time']}\t{e['stage']}\t{plain(of(e))}\t{plain(e.get('reason', ''))}\n" for e in failed))
        sinks.put_json(spark, f"{path}/run_state.json", {"ended": ended, "stages": {e["stage"]: e["event"] for e in self.events}})
        sinks.put_json(spark, f"{path}/summary.json", {"failed": self.failed(), "events": len(self.events)})


def describe(spark: SparkSession, m: Manifest, log: Log) -> DataFrame:
    """name and descriptors of every structure, rounded and written; a structure without terminal pKa values fails."""
    atoms = structures.read_structures(spark, m.inputs.structures)
    if m.descriptors.skip_unrefined:
        atoms = atoms.join(residues.unrefined(atoms).where("not all_zero").select("structure_id"), "structure_id", "left_semi")
    sasa, _ = tools.read_sasa(spark, m.inputs.tools)
    totals = sasa_totals(spark, m.inputs.tools)
    pka = tools.read_pka(spark, m.inputs.tools)
    # A charge without the pKa values of both ends of every chain would be wrong.
    ends = descriptors.missing_termini(residues.residues(atoms), pka)
    for r in ends.collect():  # violations
        log.add("describe", "failed", structure=r.key, reason=f"chain {r.detail}: {r.rule}")
    atoms = atoms.join(ends.select(F.col("key").alias("structure_id")).distinct(), "structure_id", "left_anti")
    library = tools.charge_table(spark, tools.charge_library(sinks.get_text(spark, m.inputs.charge_library)))
    wide = descriptors.describe(atoms, sasa, pka, tools.read_dssp(spark, m.inputs.tools), totals, library)
    sinks.rounded(wide.withColumnRenamed("structure_id", "name")).write.mode("overwrite").parquet(f"{m.run.output}/descriptors")
    return spark.read.parquet(f"{m.run.output}/descriptors")


def sasa_totals(spark: SparkSession, path: str) -> DataFrame:
    """structure_id, part (full, H, L), total from files stem, stem_H and stem_L."""
    _, total = tools.read_sasa(spark, path)
    part = F.regexp_extract("structure_id", r"_([HL])(?:_chain)?$", 1)
    return total.select(F.regexp_replace("structure_id", r"_([HL])(?:_chain)?$", "").alias("structure_id"), F.when(part == "", "full").otherwise(part).alias("part"), "total")


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    names = [r.path for r in tables.list_files(spark, path).select("path").collect()]
    return results.read_features(spark, path) if tables.source_kind(names) == "csv" else results.read_json(spark, path)


def prepare(assay: DataFrame, wide: DataFrame, m: Manifest) -> tuple[dict[int, DataFrame], list[str], list[str]]:
    """The merged table with folds for each seed of the folds, its targets and its features."""
    validate.require(validate.assay(assay, split="fold" if "fold" in assay.columns else None))
    targets = [c for c in assay.columns if c.startswith("target_")]
    merged = joins.merge_descriptors(assay, wide)
    own = columns.candidates(wide)
    features = columns.included(own, list(m.descriptors.features)) if m.descriptors.features else own
    table = columns.standardize(merged, "name", targets, features)
    features = [columns.normal_feature(f) for f in features]
    kind, seeds = folds.resolve_split(m.automl.split_randomly, assay.columns)
    spark = assay.sparkSession
    rows = table.select("name", *([c for c in ("heavy", "light", "fold") if c in table.columns])).orderBy("name").collect()  # an assay table is small
    names = [r.name for r in rows]
    if kind == "column":
        return {seeds[0]: folds.column_folds(table.withColumnRenamed("fold", "split"), "split").drop("split").join(spark.createDataFrame(list(zip(names, range(len(names)))), "name string, row_ord int"), "name")}, targets, features
    found = folds.sequence_folds({r.name: f"{r.heavy}{r.light}" for r in rows}) if kind == "sequence" else None
    if found:
        plans = {seeds[0]: spark.createDataFrame([(n, found[0][n], i) for i, n in enumerate(names)], "name string, fold int, row_ord int")}
    else:
        # Where sequences give no folds, they are random too.
        plans = {seed: folds.shuffled_folds(spark, names, m.automl.folds, seed) for seed in folds.RANDOM_SEEDS}
    return {seed: table.join(plan, "name") for seed, plan in plans.items()}, targets, features


def run(spark: SparkSession, m: Manifest) -> Log:
    """All stages; one that fails is logged, and what does not need it goes on."""
    log, out = Log(), m.run.output
    inputs = sinks.digests(spark, m.inputs.assays)
    before = {r.path: r.sha256 for r in inputs.collect()}
    try:
        log.add("read", "started")
        assay = tables.read_assay(spark, m.inputs.assays)
        wide = describe(spark, m, log) if "describe" in m.stages() else read_descriptors(spark, m.inputs.descriptors)
        log.write(spark, out, ended=False)
        if "cross_validate" in m.stages():
            whole = validate.absent(assay, wide, "name")
            gone = whole.collect()
            for r in gone:
                log.add("complete", "failed", structure=r.key, reason="no descriptors")
            if not gone:
                train(spark, m, assay, wide, log)
    except Exception as e:
        log.add("run", "failed", reason=f"{type(e).__name__}: {e}")
    after = {r.path: r.sha256 for r in sinks.digests(spark, m.inputs.assays).collect()}
    if after != before:
        log.add("run", "failed", reason="an input changed during the run")
    log.write(spark, out)
    return log


def train(spark: SparkSession, m: Manifest, assay: DataFrame, wide: DataFrame, log: Log) -> None:
    """Cross-validation and final models for each seed of the folds; several seeds have folders of their own."""
    seeds, targets, features = prepare(assay, wide, m)
    for seed, table in seeds.items():
        train_seed(spark, m, table, targets, features, seed, m.run.output if len(seeds) == 1 else f"{m.run.output}/rs{seed}", log)


def train_seed(spark: SparkSession, m: Manifest, table: DataFrame, targets: list[str], features: list[str], seed: int, out: str, log: Log) -> None:
    for t in targets:
        validate.drop_missing_targets(table, t, m.automl.most_missing)
        # A target whose folds are out of balance is left out; the others go on.
        bad = validate.unbalanced_folds(table.where(F.col(t).isNotNull()).select(F.lit(t).alias("target"), "fold"), ["target"]).collect()
        if bad:
            log.add("cross_validate", "skipped", seed=seed, target=t, reason=f"{bad[0].rule} {bad[0].detail}")
            targets = [x for x in targets if x != t]
    if not targets:
        return
    table.write.mode("overwrite").parquet(f"{out}/table")
    table = spark.read.parquet(f"{out}/table")
    known = [t for t in crossval.TECHNIQUES if t.name in m.automl.techniques]
    # A run may have ended before its later seeds began.
    done = spark.read.parquet(f"{out}/results") if m.run.resume and sinks.exists(spark, f"{out}/results") else None
    if done is not None and "seed" not in done.columns:
        raise ValueError("finished results have no seed: run anew")
    found = crossval.cross_validate(table, targets, features, known, done, seed, m.automl.cv == "flat")
    found.write.mode("append" if m.run.resume else "overwrite").parquet(f"{out}/results")
    results_ = spark.read.parquet(f"{out}/results").where("error is null")
    # A task that failed in an earlier run and has ended since has not failed; one that failed again is told once.
    failed = spark.read.parquet(f"{out}/results").where("error is not null").join(results_.select("task_id"), "task_id", "left_anti")
    for r in failed.groupBy("task_id").agg(F.first("error").alias("error")).collect():
        log.add("cross_validate", "failed", task=r.task_id, reason=r.error)
    sinks.write_run(results_, out)
    log.add("cross_validate", "ended", seed=seed, tasks=results_.count())
    log.write(spark, m.run.output, ended=False)
    if "final_models" in m.stages():
        final_models(spark, table.toPandas(), results_, features, {t.name: t for t in known}, out, log)


def final_models(spark: SparkSession, table: pd.DataFrame, found: DataFrame, features: list[str], known: dict, out: str, log: Log) -> None:
    if found.where("inner_pooled_spearman is null").select("target_col", "technique").distinct().groupBy("target_col").count().where("count > 1").count():
        log.add("final_models", "failed", reason="flat cross-validation has no inner scores to choose a technique by: name one technique")
        return
    chosen = selection.deployed_technique(found).join(selection.refit_settings(found, ["eval_model", "alpha", "l1_ratio"]), ["target_col", "technique"])
    index = []
    for r in chosen.collect():  # a row a target
        settings = {"alpha": r.alpha, "l1_ratio": r.l1_ratio} if r.eval_model == "elasticnet" else known[r.technique].settings.get(r.eval_model, {})
        model = crossval.refit(table, r.target_col, known[r.technique], r.eval_model, settings, features)
        path = f"{out}/models/{r.target_col}.json"
        index.append({"target": r.target_col, "path": path, "sha256": sinks.put_json(spark, path, model)})
        log.add("final_models", "written", target=r.target_col, technique=r.technique)
    sinks.put_json(spark, f"{out}/models/index.json", index)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(sinks.get_text(spark, path))
