"""Parameter sets written as one underscore-joined string."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and order of the parts of a parameter string, and their types.
PARAM_NAMES = {
    "rf": ("n_estimators", "max_features"),
    "xgboost": ("n_estimators", "learning_rate", "subsample", "max_depth", "colsample_bytree", "min_child_weight"),
    "logit": ("C",),
    "svm": ("C", "gamma"),
    "gbm": ("n_estimators", "max_features", "learning_rate"),
    "dt": (),
    "lstm": ("lstmsize", "dropout", "n_layers", "batch_size", "optimizer", "learning_rate", "nb_epoch"),
}
PARAM_TYPES = {"n_estimators": "int", "max_depth": "int", "min_child_weight": "int", "lstmsize": "int",
               "n_layers": "int", "batch_size": "int", "nb_epoch": "int", "optimizer": "string"}


def param_type(name: str) -> str:
    return PARAM_TYPES.get(name, "double")


def parse_params(text: Column, names: Sequence[str]) -> Column:
    """``"500_0.3"`` -> struct of typed fields; a part that is absent is null."""
    parts = F.split(text, "_")
    return F.struct(*[F.get(parts, F.lit(i)).try_cast(param_type(n)).alias(n) for i, n in enumerate(names)])


def params_map(text: Column, names: Sequence[str]) -> Column:
    """The same as a map of strings."""
    keys = F.array(*[F.lit(n) for n in names])
    return F.map_from_arrays(F.slice(keys, F.lit(1), F.size(F.split(text, "_"))),
                             F.slice(F.split(text, "_"), 1, len(names)))


def format_params(params: Column, names: Sequence[str]) -> Column:
    return F.concat_ws("_", *[params[n].cast("string") for n in names])


def params_from_text(text: str, kind: str) -> dict:
    """Driver-side twin for one parameter set."""
    convert = {"int": lambda x: int(float(x)), "double": float, "string": str}
    return {n: convert[param_type(n)](v) for n, v in zip(PARAM_NAMES[kind], text.split("_"))}


def params_to_text(params: Mapping, kind: str) -> str:
    return "_".join(str(params[n]) for n in PARAM_NAMES[kind] if n in params)
