"""Training-data operators. Nothing else in the library imports this subpackage.

Every operator module has a general interface of its own; the thin registered queries, which
derive the contracted columns, are in ``factloom.llm.queries``.
"""
