"""Compares synthetic activity schedules with observed ones, on Spark."""

from .operators.pairwise import PairwiseResult, PairwiseSpec, pairwise_distances
from .plans.evaluate import AggregatedResult, EvalResult, Evaluator, SplitNotAvailableError, compare, compare_splits, evaluate, subsample_and_evaluate
from .plans.jobs import Feature, Jobs, get_jobs
from .schema import canonical

__all__ = ["AggregatedResult", "EvalResult", "Evaluator", "Feature", "Jobs", "PairwiseResult", "PairwiseSpec", "SplitNotAvailableError", "canonical", "compare", "compare_splits", "evaluate", "get_jobs", "list_features", "pairwise_distances", "subsample_and_evaluate"]


def list_features(spark=None):
    """(domain, name, config_key, description, in_default_config) of every feature."""
    from pyspark.sql import SparkSession

    from .plans.jobs import catalogue

    return (spark or SparkSession.active()).createDataFrame(catalogue(), "domain string, name string, config_key string, description string, in_default_config boolean")
