"""A builder of frames, column by column."""

from __future__ import annotations

from typing import Any

from keyloom.frame import KeyedFrame


class ColumnBuilder:
    """Collects edits to a frame; ``build()`` applies them.

    ``b["x"] = selector`` sets or appends a column, ``del b["x"]`` removes one, ``insert_after`` and
    ``insert_before`` place one.  The frame it starts from stays as it is.
    """

    def __init__(self, frame: KeyedFrame):
        self._frame = frame

    def __setitem__(self, name: str, selector: Any) -> None:
        self._frame = self._frame.transform({name: selector})

    def __getitem__(self, name: Any) -> Any:
        return self._frame.column(name)

    def __delitem__(self, name: Any) -> None:
        gone = self._frame.names(name)
        self._frame = self._frame.select([c for c in self._frame.columns if c not in gone])

    def insert_after(self, place: Any, name: str, selector: Any) -> None:
        self._frame = self._frame.insertcolsafter(place, {name: selector})

    def insert_before(self, place: Any, name: str, selector: Any) -> None:
        self._frame = self._frame.insertcolsbefore(place, {name: selector})

    def rename(self, old: Any, new: str) -> None:
        self._frame = self._frame.rename({old: new})

    def build(self) -> KeyedFrame:
        return self._frame
