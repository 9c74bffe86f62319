"""Outcome prediction over event logs, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from tracewise.eventlog import EventLog
from tracewise.session import build_session
from tracewise.spec import LogSpec, spec, spec_names

# Python workers get the functions themselves, as they may have no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["EventLog", "LogSpec", "build_session", "spec", "spec_names"]
