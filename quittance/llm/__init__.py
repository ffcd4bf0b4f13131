"""Operators for preparing language-model training data.

Nothing else in the library imports this package.  Ten operators, each in a
module of its own; ``queries`` holds the thin ``opN_*`` queries over them.
"""
