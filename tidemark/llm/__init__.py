"""Operators for preparing language-model training data at scale.

Every module holds one operator with a general interface; ``queries`` derives
the digest columns of the registered queries from those operators.
"""
