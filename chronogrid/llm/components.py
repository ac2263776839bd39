"""Connected components of a graph given by its edges."""

from ..components import connected_components

__all__ = ["connected_components"]
