"""Operators for large training corpora.

Each module holds one operator (``DataFrame -> DataFrame``) and reads only
the columns it names, so extra columns of any name do no harm.
``queries`` holds the thin registered queries and their SQL.
Nothing else in the library imports this subpackage.
"""
