"""labelloom: labelled-media analytics as Spark jobs.

Sub-packages
------------
``sources``    scans and sinks (manifests, matrices, splits, runs, frames)
``functions``  column expressions (labels, vectors, geometry, quality, scores)
``operators``  DataFrame -> DataFrame operators (splits, joins, metrics, votes)
``plans``      whole jobs composed of the above
``streaming``  Structured Streaming twins of the session operators
"""

import sys

from pyspark import cloudpickle

from labelloom.session import get_session, shared_folder

# Functions sent to Python workers carry their code with them, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "shared_folder"]
