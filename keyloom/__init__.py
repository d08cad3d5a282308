"""Keyed-table analytics and data preparation on Spark DataFrames."""

from keyloom import aggs, diagnostics, methods  # noqa: F401
from keyloom.builder import ColumnBuilder
from keyloom.frame import KeyedFrame, array, table
from keyloom.operators.features import Categorical, Continuous, Maybe, featuremat, splitschema
from keyloom.operators.features import schema as feature_schema
from keyloom.operators.group import Mergeable
from keyloom.operators.joins import broadcast, map_pair
from keyloom.operators.sets import fromchunks
from keyloom.selectors import All, Between, Keys, Named, Not, Via
from keyloom.sources.csv import csvread, dateformat, glob, ingest, ingest_append, load_array, load_files, load_table
from keyloom.sources.store import load, save

__all__ = [
    "All", "Between", "Categorical", "ColumnBuilder", "Continuous", "KeyedFrame", "Keys", "Maybe", "Mergeable", "Named", "Not", "Via",
    "aggs", "array", "broadcast", "csvread", "dateformat", "diagnostics", "feature_schema", "featuremat", "fromchunks",
    "glob", "ingest", "ingest_append", "load", "load_array", "load_files", "load_table", "map_pair", "save", "splitschema", "table",
]
