"""Operators for preparing language-model training data.

Each module holds one operator with a general interface.  ``queries`` binds
them to the registered ``opN_*`` queries, ``oracles`` has the SQL forms.
Nothing outside this subpackage imports it.
"""
