"""Operators for preparing large text corpora (training data pipelines).

Nothing else in the package imports this subpackage.  Each operator module
holds one method; ``queries.py`` registers the ``opN_<name>`` queries and
their SQL, and ``corpus_pipeline.py`` at the repository top chains five of
the operators.
"""
