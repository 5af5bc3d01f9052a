"""Scalar functions as Column expressions; no Python runs per row."""

from ebbline.functions.scalar import *  # noqa: F403
