"""Operators for preparing training text at corpus scale.

Nothing outside this folder imports it.  Each module holds one operator, its
query (`query`) and, where SQL can express it, its DuckDB text (`SQL`).
"""
