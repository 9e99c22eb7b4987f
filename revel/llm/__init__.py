"""Operators for preparing language-model training data.

Each numbered operator lives in its own module (``op01_quality`` ...
``op13_fim``) as a DataFrame -> DataFrame function with general
parameters; ``queries`` registers one thin query per operator.  Nothing
outside this subpackage imports it.
"""
