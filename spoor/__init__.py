"""Spoor: program-behaviour analytics on Spark DataFrames."""

from spoor.session import build_session

__all__ = ["build_session"]
