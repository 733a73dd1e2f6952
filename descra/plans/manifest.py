"""A run's settings: sections with closed sets of keys, all problems reported together, and the stages that follow."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from descra.functions.scalars import as_bool, as_int, as_list

STAGES = ("read", "describe", "complete", "cross_validate", "final_models")
TECHNIQUES, CV = ("elasticnet", "intercorr_svm", "sfs_svm", "sfs_knn"), ("nested", "flat")


class ManifestError(ValueError):
    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Inputs:
    assays: str = ""
    structures: str | None = None
    descriptors: str | None = None
    tools: str | None = None
    charge_library: str | None = None
    excluded: tuple[str, ...] = ()


@dataclass(frozen=True)
class Run:
    output: str = ""
    resume: bool = False


@dataclass(frozen=True)
class Descriptors:
    enabled: bool = True
    skip_unrefined: bool = False
    features: tuple[str, ...] = ()


@dataclass(frozen=True)
class Automl:
    enabled: bool = True
    techniques: tuple[str, ...] = TECHNIQUES
    cv: str = "nested"
    split_randomly: bool = False
    folds: int = 5
    final_model: bool = True
    most_missing: float = 0.7


@dataclass(frozen=True)
class Manifest:
    inputs: Inputs = field(default_factory=Inputs)
    run: Run = field(default_factory=Run)
    descriptors: Descriptors = field(default_factory=Descriptors)
    automl: Automl = field(default_factory=Automl)

    def stages(self) -> tuple[str, ...]:
        out = ["read"]
        if self.descriptors.enabled and self.inputs.structures:
            out.append("describe")
        if self.automl.enabled:
            out += ["complete", "cross_validate", *(["final_models"] if self.automl.final_model else [])]
        return tuple(out)

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def parse(settings: dict) -> Manifest:
    problems: list[str] = []
    sections = {"inputs": Inputs, "run": Run, "descriptors": Descriptors, "automl": Automl}
    if not isinstance(settings, dict):
        raise ManifestError(["settings must be a mapping"])
    problems += [f"unknown section {k}" for k in settings if k not in sections]
    made = {}
    for name, kind in sections.items():
        given = settings.get(name) or {}
        if not isinstance(given, dict):
            problems.append(f"{name} must be a mapping")
            continue
        fields = {f: kind.__dataclass_fields__[f].default for f in kind.__dataclass_fields__}
        problems += [f"{name}: unknown key {k}" for k in given if k not in fields]
        out = {}
        for k, default in fields.items():
            if k not in given:
                continue
            try:
                v = given[k]
                out[k] = as_bool(v, f"{name}.{k}") if isinstance(default, bool) else as_int(v, f"{name}.{k}") if isinstance(default, int) else float(v) if isinstance(default, float) else tuple(as_list(v, f"{name}.{k}")) if isinstance(default, tuple) else None if v is None else str(v)
            except (TypeError, ValueError) as e:
                problems.append(str(e))
        made[name] = kind(**out)
    if not problems:
        m = Manifest(**made)
        problems += [f"inputs.{k} is required" for k in ("assays",) if not getattr(m.inputs, k)]
        problems += ["run.output is required"] if not m.run.output else []
        problems += [] if m.inputs.structures or m.inputs.descriptors else ["inputs needs structures or descriptors"]
        problems += [f"automl.techniques: {t} is none of {', '.join(TECHNIQUES)}" for t in m.automl.techniques if t not in TECHNIQUES]
        problems += [] if m.automl.cv in CV else [f"automl.cv must be one of {', '.join(CV)}"]
        problems += [] if m.automl.folds >= 2 else ["automl.folds must be 2 or more"]
        if not problems:
            return m
    raise ManifestError(problems)


def load(text: str) -> Manifest:
    """From JSON, or from YAML where a YAML library is there."""
    try:
        return parse(json.loads(text))
    except json.JSONDecodeError:
        pass
    try:
        import yaml
    except ImportError:
        raise ManifestError(["settings are not JSON, and no YAML library is installed"]) from None
    return parse(yaml.safe_load(text))
