"""Connected components: the core's."""

from ..operators.graph import components

__all__ = ["components"]
