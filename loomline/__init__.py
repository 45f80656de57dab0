"""loomline: document, retrieval and data-cleaning analytics expressed as Spark plans."""

__version__ = "0.1.0"
