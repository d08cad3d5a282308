"""Operators, also available as methods of `KeyedFrame` (attached by `keyloom.methods`)."""
