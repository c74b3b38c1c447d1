"""promptlake: analytics over chat-model traffic, written as Spark DataFrame operators."""

from promptlake.config import Config
from promptlake.rules import Rules

__all__ = ["Config", "Rules"]
