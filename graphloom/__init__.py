"""graphloom: code-graph analytics expressed as Spark DataFrame programs."""

from graphloom.model import PropertyGraph

__all__ = ["PropertyGraph"]
