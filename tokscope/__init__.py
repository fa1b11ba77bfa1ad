"""tokscope: token-vocabulary analytics on Spark.

Sub-packages: ``sources`` (readers), ``functions`` (column expressions),
``operators`` (DataFrame operators), ``plans`` (jobs, registered queries,
oracle SQL), ``streaming`` (running counts), ``sinks`` (writers).
"""

__version__ = "0.1.0"
