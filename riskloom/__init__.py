"""Content risk analytics on Spark: rules over text, findings, scores, history, reports."""

import sys

from pyspark import cloudpickle

from .rules import CATALOG, RuleSpec, select_rules

__version__ = "0.1.0"

__all__ = ["CATALOG", "RuleSpec", "select_rules", "__version__"]

# Functions and classes for tasks travel with what they use, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
