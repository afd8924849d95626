"""The query catalogue: every operator over the shared tables, with equivalent SQL."""

from .catalogue import QUERIES
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]
