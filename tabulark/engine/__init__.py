"""Tables that change, indexes, and the statements over them."""

from .session import Engine, EngineError, Result

__all__ = ["Engine", "EngineError", "Result"]
