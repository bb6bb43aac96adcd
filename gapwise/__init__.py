"""gapwise: missing-data analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel with the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from gapwise.errors import EngineError  # noqa: E402
from gapwise.operators.inject import inject_missing, mask_where, resolve_missing  # noqa: E402
from gapwise.plans.compare import compare_methods  # noqa: E402
from gapwise.plans.registry import METHODS, Result, fit, impute  # noqa: E402
from gapwise.plans.report import Report, analyse  # noqa: E402
from gapwise.sources.tables import load_dataset, read_csv_table, read_table, validate_frame  # noqa: E402

__all__ = [
    "METHODS", "EngineError", "Report", "Result", "analyse", "compare_methods", "fit", "impute",
    "inject_missing", "load_dataset", "mask_where", "read_csv_table", "read_table",
    "resolve_missing", "validate_frame",
]
