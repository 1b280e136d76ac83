"""Patterns and their column functions."""

from .dialect import parse
from .errors import MatchLimitExceeded, PatternError
from .patterns import Options, Pattern, compile, escape, escape_column, match_bytes, match_is_empty, match_length

__all__ = ["MatchLimitExceeded", "Options", "Pattern", "PatternError", "compile", "escape", "escape_column", "match_bytes", "match_is_empty", "match_length", "parse"]
