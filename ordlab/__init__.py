"""ordlab: ordinal-outcome analytics on Spark DataFrames.

Every operator is a ``DataFrame -> DataFrame`` function (or a ``pyspark.ml``
Estimator/Transformer where it keeps fitted state).  Sub-packages:

- ``ordlab.sources``   table loader, file sources and sinks
- ``ordlab.functions`` column-expression helpers (scalar functions)
- ``ordlab.operators`` relational and ML operators
- ``ordlab.plans``     the registered query catalogue and its SQL oracles
- ``ordlab.streaming`` the incremental learner on Structured Streaming
"""

from ordlab.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
