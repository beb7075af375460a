"""File-estate and payload-reduction analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from shrinkwise.config import JobRequest, Quota, ResizeSpec

# Functions sent to Python workers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["JobRequest", "Quota", "ResizeSpec"]
