"""Whole jobs composed from the operators."""

from .curation import CurationResult, run_curation
from .training import run_training

__all__ = ["CurationResult", "run_curation", "run_training"]
