"""Operators for preparing training text: classifiers, near-duplicate removal, decontamination, personal data, mixing, archives."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
