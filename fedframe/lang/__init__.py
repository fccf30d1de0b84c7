"""The find dialect: lexer, syntax tree and parser."""

from .parser import parse, parse_one

__all__ = ["parse", "parse_one"]
