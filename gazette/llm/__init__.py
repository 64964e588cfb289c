"""Operators of a training-data pipeline: tokens, packing, de-duplication, quality, search, archives, chats.

Functions that run on workers travel with the query, so executors need not have this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
