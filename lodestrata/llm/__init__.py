"""Operations of a large-scale training-data pipeline, one module per operator.

Nothing outside this package imports it; ``queries.py`` holds its registered
queries and their SQL.
"""
