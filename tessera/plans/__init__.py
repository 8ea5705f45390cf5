"""Registered queries over the test tables, by family."""

from . import extras, inference, projections, relations, streams
from .registry import QUERIES

__all__ = ["QUERIES", "extras", "inference", "projections", "relations", "streams"]
