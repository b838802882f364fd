"""raylattice: a PySpark-native engine for computed-tomography data and for the data around it."""

__version__ = "0.1.0"
