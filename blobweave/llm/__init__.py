"""Corpus operators for preparing training data.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrame to DataFrame; ``queries`` binds them to the tables of a
data folder.
"""
