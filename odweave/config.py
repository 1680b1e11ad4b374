"""Settings of a run: paths, keys, predictors, and the parameters of spatial statistics and models; read from JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class Spatial:
    identifier: str = "area"
    geometry_column: str = "ring"
    crs: str = "EPSG:27700"
    weights: str = "queen"


@dataclass
class Specification:
    response_variable: str = "log_revenue"
    predictors: list[str] = field(default_factory=list)


# Seeds, permutations, folds and model parameters of the published runs.
@dataclass
class Statistics:
    permutations: int = 999
    random_seed: int = 20260722
    significance: float = 0.05


@dataclass
class Validation:
    n_folds: int = 5
    test_fold: int = 0
    random_seed: int = 20260722


@dataclass
class Models:
    trees: int = 500
    forest_depth: int = 30
    rounds: int = 500
    learning_rate: float = 0.05
    boosting_depth: int = 3
    subsample: float = 0.8


@dataclass
class Settings:
    inputs: dict[str, str] = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)
    spatial: Spatial = field(default_factory=Spatial)
    model_specification: Specification = field(default_factory=Specification)
    esda: Statistics = field(default_factory=Statistics)
    spatial_cv: Validation = field(default_factory=Validation)
    models: Models = field(default_factory=Models)

    @classmethod
    def read(cls, path: str) -> Settings:
        return _fill(cls, json.loads(Path(path).read_text(encoding="utf-8")), "settings")

    def write(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2) + "\n", encoding="utf-8")


def _fill(kind: type, values: dict, where: str):  # noqa: ANN202
    """A settings object; a name that it does not know is an error."""
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"{where}: unknown {', '.join(unknown)}")
    default = kind()
    return kind(**{k: _fill(type(getattr(default, k)), v, f"{where}.{k}") if is_dataclass(getattr(default, k)) else v for k, v in values.items()})
