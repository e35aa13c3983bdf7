"""Deductive, graph, text and vector analytics on Spark DataFrames."""

from tesserae.plans.ir import EngineError
from tesserae.session import Session

__all__ = ["EngineError", "Session"]
