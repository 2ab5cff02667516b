"""Graphloom: text, knowledge-graph, retrieval and learner analytics on PySpark DataFrames."""

__version__ = "0.1.0"
