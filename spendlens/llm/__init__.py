"""Operators that prepare text corpora for language-model training.

Each module holds one operator with its own general interface;
``catalog`` registers the ``opN_<name>`` queries over the given tables.
Nothing outside this subpackage imports it.
"""
