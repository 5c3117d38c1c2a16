"""Named Spark operators for document archives, camera events, photo catalogues and account records."""

__version__ = "0.1.0"
