"""tessella: a Spark-native multi-model analytics engine.

Relational tables, document collections, time series, property graphs and a
key/value surface are compiled to DataFrame plans, so that Catalyst and
Tungsten choose the physical strategy.
"""

__version__ = "0.1.0"
