"""Operators for preparing language-model training text.

Nothing else in the library imports this subpackage; it only relies on Spark,
numpy and the tokenizer files whose location is a parameter.
"""
