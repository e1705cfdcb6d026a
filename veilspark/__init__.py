"""Sensitive-data detection and redaction over Spark DataFrames."""

from veilspark.operators.detector import Detector, filter_text, register_sql, scan_text
from veilspark.plans.config import COMPATIBLE, WHOLE, Config, CustomRule, DetectionConfig, Limits

__all__ = [
    "COMPATIBLE",
    "WHOLE",
    "Limits",
    "Config",
    "CustomRule",
    "DetectionConfig",
    "Detector",
    "filter_text",
    "register_sql",
    "scan_text",
]
