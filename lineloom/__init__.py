"""lineloom: command-grammar analytics and text-corpus operators on Spark."""

__version__ = "0.1.0"
