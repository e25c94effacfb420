"""Every registered query of the library: name -> function (spark, sf_dir), and name -> SQL."""

from __future__ import annotations

from .plans import annotation, encoders, label_values, labels, metrics, models, rasters, round_trips, sequences, signals, validation, vectors  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401
