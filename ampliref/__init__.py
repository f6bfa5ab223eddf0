"""ampliref: a PySpark-native engine for DNA barcode reference collections."""

__version__ = "0.1.0"
