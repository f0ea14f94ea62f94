"""weftlake: retrieval analytics and data comparison as PySpark DataFrame plans."""

__version__ = "0.1.0"
