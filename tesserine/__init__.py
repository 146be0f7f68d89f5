"""Tesserine: a PySpark-native analytics engine for web-page content.

``functions`` holds Column -> Column expressions, ``operators`` DataFrame ->
DataFrame operators, ``sources`` readers and writers, ``plans`` the query
catalogue with its SQL twins, ``streaming`` Structured Streaming jobs.  The
subpackage ``llm`` (training-data operators) is optional and nothing outside
it imports it.
"""

__version__ = "0.1.0"
