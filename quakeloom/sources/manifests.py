"""Static relations: the pipelines to be compared and the metrics they are judged by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PIPELINE_COLUMNS = "pipeline inputs candidate_generation family_assignment blind_to detection_status family_assignment_status status".split()
METRIC_COLUMNS = "claim primary_metric comparison pass_gate current_status".split()

# pipelines
PIPELINES = [
    ("network_only", "NCEDC DD plus continuous HRSN; add regional NCSN where HRSN is unavailable", "strong conventional phase association and multi-template matched filtering on the exact DAS UTC intervals",
     "published-family multi-anchor waveform features plus differential relocation", "DAS trigger times and DAS scores", "NOT_RUN", "CORRELATION_ONLY_DIAGNOSTIC_COMPLETE; DIFFERENTIAL_RELOCATION_NOT_RUN", "NOT_RUN"),
    ("das_only", "continuous DAS within homogeneous configuration epochs", "array-coherent phase picking and/or multi-channel template matching",
     "DAS similarity to withheld family templates", "network trigger times and network scores", "NOT_RUN", "NOT_RUN", "NOT_RUN"),
    ("joint", "frozen network-only and DAS-only candidate/score products", "predeclared evidence fusion; no retuning on test labels",
     "combined likelihood with an explicit abstain class", "held-out adjudication labels", "NOT_RUN", "NOT_RUN", "NOT_RUN"),
]
# metrics
METRICS = [
    ("catalog_detection_extension", "event recall at matched event-level false-discovery rate", "joint versus network_only and das_only versus network_only",
     "bootstrap lower confidence bound on recall difference is greater than zero", "STOP"),
    ("catalog_completeness_extension", "validated detection probability versus magnitude and completeness magnitude", "same UTC/configuration intervals for all pipelines",
     "DAS gain persists after distance, noise, and configuration stratification", "STOP"),
    ("family_classification_extension", "event-level macro F1 and cross-family merge rate", "joint versus network_only on held-out family-labeled events",
     "bootstrap F1 improvement above zero without reduced target precision", "STOP"),
    ("near_source_resolution_extension", "within-family versus between-family DAS differential-time/spatial-distance separation", "same-config positive and neighboring-family controls",
     "effect exceeds block-bootstrap uncertainty and survives band/channel sensitivity", "STOP"),
]


def pipeline_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PIPELINES, PIPELINE_COLUMNS)


def metric_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, METRIC_COLUMNS)
