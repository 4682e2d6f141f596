"""Clone typing of cells and spatial spots as PySpark DataFrame queries."""

__version__ = "0.1.0"
