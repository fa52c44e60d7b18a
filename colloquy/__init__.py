"""Colloquy: conversation and document analytics on PySpark.

The core (``functions``, ``operators``, ``sources``, ``plans``, ``streaming``)
never imports the ``llm`` subpackage; that subpackage holds the operators for
training data and may use the core.
"""

__version__ = "0.1.0"
