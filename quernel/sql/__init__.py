"""The dialect: text to syntax tree to DataFrame."""

from quernel.sql.parser import parse, parse_select

__all__ = ["parse", "parse_select"]
