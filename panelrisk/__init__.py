"""panelrisk — keyed-panel risk analytics on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL expressions and ``pyspark.ml``; see ``panelrisk.plans.queries``
for the registered queries and ``panelrisk.plans.oracle`` for their SQL
oracles.
"""

__version__ = "0.1.0"
