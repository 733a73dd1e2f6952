"""Column roles by name: normalised features, subsets, groups, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = ("surface", "general", "core", "sequence_motives")
#: Prefixes that a feature loses; core_ stays.
STRIPPED = ("surface_", "general_", "sequence_motives_")
META = ("name", "error", "index", "pdb_file", "antibody_id", "residue_number")


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def normal_feature(name: str) -> str:
    name = name.removeprefix("feature_")
    for p in STRIPPED:
        if name.startswith(p):
            return name.removeprefix(p)
    return name


def standardize(df: DataFrame, name: str, targets: list[str], features: list[str]) -> DataFrame:
    """Columns renamed to ``name``, ``target_*`` and normalised features; two that end alike are an error."""
    new = {name: "name"} | {t: t if t.startswith("target_") else f"target_{t}" for t in targets} | {f: normal_feature(f) for f in features}
    out = [new.get(c, c) for c in df.columns]
    clash = sorted({c for c in out if out.count(c) > 1})
    if clash:
        raise ValueError(f"columns end with the same name: {', '.join(clash)}")
    return df.toDF(*out)


def subset(df: DataFrame, names: list[str]) -> DataFrame:
    """These columns in this order, each once."""
    names = list(dict.fromkeys(names))
    gone = [c for c in names if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df.select(*[F.col(quoted(c)) for c in names])


def candidates(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META and not c.startswith("target_")]


def in_groups(names: list[str], groups: list[str]) -> list[str]:
    kept = [c for c in names if any(c == g or c.startswith(f"{g}_") for g in groups)]
    if not kept:
        raise ValueError(f"no column is in {', '.join(groups)}")
    return kept


def included(names: list[str], wanted: list[str]) -> list[str]:
    """Each wanted column by its name, else the only one with that leaf name."""
    out = []
    for w in wanted:
        hits = [w] if w in names else [c for c in names if normal_feature(c) == normal_feature(w)]
        if len(hits) != 1:
            raise ValueError(f"{w} is {'ambiguous' if hits else 'missing'}")
        out += hits
    return list(dict.fromkeys(out))


def experimental_features(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("feature_")]


def role_conflicts(name: str, split: str | None, targets: list[str], features: list[str]) -> list[str]:
    out = [f"{c} is given twice as {kind}" for kind, some in (("target", targets), ("feature", features)) for c in sorted({c for c in some if some.count(c) > 1})]
    for c in (name, *([split] if split else [])):
        out += [f"{c} is also a {kind}" for kind, some in (("target", targets), ("feature", features)) if c in some]
    return out + [f"{c} is target and feature" for c in sorted(set(targets) & set(features))]
