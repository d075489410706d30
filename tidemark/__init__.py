"""Interval analytics over cumulative workload counters, as Spark DataFrame functions."""

from tidemark.config import StoreConfig
from tidemark.store import Inputs, Store

__all__ = ["Inputs", "Store", "StoreConfig"]
