"""Draft outcome analytics on Spark."""

from .operators.curate import curate, hash_sample, keep_latest, latest_eligible, with_version_name
from .operators.encode import (
    DraftEncoder,
    DraftEncoderModel,
    PreparedFeatures,
    binary_target,
    prepare_features,
    validate_features,
)
from .operators.models import BaselineRun, evaluate_model, train_baselines
from .operators.quality import require_columns
from .operators.split import chronological_split
from .plans import run_curation, run_training
from .schema import DRAFT, FORBIDDEN, SPLITS, STRICT_FORBIDDEN, DraftSchema

__all__ = [
    "BaselineRun",
    "DRAFT",
    "DraftEncoder",
    "DraftEncoderModel",
    "DraftSchema",
    "FORBIDDEN",
    "PreparedFeatures",
    "SPLITS",
    "STRICT_FORBIDDEN",
    "binary_target",
    "chronological_split",
    "curate",
    "evaluate_model",
    "hash_sample",
    "keep_latest",
    "latest_eligible",
    "prepare_features",
    "require_columns",
    "run_curation",
    "run_training",
    "train_baselines",
    "validate_features",
    "with_version_name",
]
