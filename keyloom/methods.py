"""Attaches the operators to ``KeyedFrame`` as methods."""

from keyloom.frame import KeyedFrame
from keyloom.operators import features, filters, group, joins, project, reshape, sets, windows

_METHODS = {
    project: ("select", "rows", "column", "pairs", "transform", "insertcols", "insertcolsafter", "insertcolsbefore",
              "rename", "reindex", "permutedims", "selectkeys", "selectvalues", "convertdim", "dropmissing", "convertmissing"),
    filters: ("filter", "mask", "at", "subtable", "row_at", "upsert"),
    group: ("reduce", "reducedim", "reducedim_vec", "groupreduce", "groupby", "summarize", "fold", "mapchunks", "countmap", "mosaic", "partitioned"),
    joins: ("join", "innerjoin", "naturaljoin", "leftjoin", "groupjoin", "asofjoin", "rechunk_together"),
    sets: ("sort", "top", "rechunk", "merge", "isequal", "equal", "unique", "intersect", "subtract", "distribute"),
    reshape: ("stack", "unstack", "flatten", "mapslices"),
    windows: ("rank", "topk", "lagdiff", "groupvalue"),
    features: ("featuremat",),
}
for _module, _names in _METHODS.items():
    for _name in _names:
        setattr(KeyedFrame, _name, getattr(_module, _name))
KeyedFrame.map = project.map_rows
KeyedFrame.column_frames = project.columns
KeyedFrame.key_rows = project.key_rows
KeyedFrame.value_rows = project.value_rows
KeyedFrame.feature_schema = features.schema
KeyedFrame.insert_row = filters.upsert
KeyedFrame.aggregate_stats = group.groupreduce
