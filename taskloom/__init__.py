"""taskloom: set-based analytics over the tables of an agent-operations platform, on PySpark."""

import sys

from pyspark import cloudpickle

from .model import Principal, Tables

# Executors need not have this package installed: the few Python functions sent to them travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Principal", "Tables"]
