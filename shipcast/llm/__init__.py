"""Training-data pipeline operators.

Each module holds one operator; ``catalog`` registers their queries.  Nothing
outside this subpackage imports it.
"""
