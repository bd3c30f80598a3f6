"""Where rows come from and go to."""

from .catalog import Frames, Jdbc, ParquetFolder
from .store import Store

__all__ = ["Frames", "Jdbc", "ParquetFolder", "Store"]
