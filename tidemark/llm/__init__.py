"""Training-data operators: one module per operator, queries in ``queries``.

Nothing outside this subpackage imports it.
"""
