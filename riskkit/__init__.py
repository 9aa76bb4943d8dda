"""riskkit: tabular risk modelling on Spark DataFrames.

Every public operator is either a ``DataFrame -> DataFrame`` function (column
names are parameters, survey names are only defaults), a ``Column`` builder,
or a Spark ML ``Estimator``/``Transformer``.  Sub-packages:

* ``sources``   - scans and sinks (CSV/Parquet/JSON, component folders, models)
* ``functions`` - column expressions: schema resolution, casts, missing codes,
                  row-wise arithmetic, bins and flags
* ``operators`` - relational operators: merge, profile, rank, survey
                  derivations, splits, preprocessing, models, metrics, explain
* ``streaming`` - batch and streaming scoring with risk level and advice
* ``plans``     - the registered queries and their SQL oracles
"""

__version__ = "0.1.0"
