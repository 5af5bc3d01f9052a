"""Churn modelling on user features."""

from ebbline.ml.churn import build_pipeline, cross_validate, evaluate, should_deploy, train_churn

__all__ = ["build_pipeline", "cross_validate", "evaluate", "should_deploy", "train_churn"]
