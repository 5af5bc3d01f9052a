"""Data quality: fused checks, suites with tolerances, and row tests."""

from ebbline.quality.checks import Check, CheckResult, DataQualityError, DataQualityRunner, Report, Severity, Status
from ebbline.quality.generic import *  # noqa: F403
from ebbline.quality.suite import Expectation, run_suite

__all__ = ["Check", "CheckResult", "DataQualityError", "DataQualityRunner", "Expectation", "Report", "Severity", "Status", "run_suite"]
