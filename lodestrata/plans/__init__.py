"""All registered queries of the engine."""

from . import candidates, citations, facts, linking, packets, rasters, readers, relational, retrieval, searching, sequential, signals, steps, streaming, surfaces, text_mining, time_series  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
