"""Corpus health analytics and training-data preparation on PySpark.

Every operator is a ``DataFrame -> DataFrame`` transform: the same functions
run on a directory of files (``gleanery.sources``) or on any table that has an
id and a text column (``gleanery.plans.corpus``).
"""

__version__ = "0.1.0"
