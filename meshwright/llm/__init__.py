"""Operators for preparing training data, apart from the graph engine.

Nothing outside this folder imports it; `queries` holds what the driver runs.
"""
