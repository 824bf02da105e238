"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  ``queries.py`` names the
registered queries, ``oracles.py`` holds the SQL of those that SQL can express.

Conventions shared by all operators: the input is a frame with ``doc_id`` (long)
and ``text`` (string); every other column, whatever its name, is ignored, so
extra columns cannot clash; a null text is treated as empty; every row is a
document of its own, repeated ids and rows included; an empty table gives an
empty result of the same schema.
"""
