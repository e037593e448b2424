"""What a user searched for before, kept in one JSON file on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

#: Entries kept of each list, the newest first.
KEPT = {"history": 200, "roots": 50, "saved": 50, "bookmarks": 200}


@dataclass
class LocalState:
    path: str
    history: list = field(default_factory=list)
    roots: list = field(default_factory=list)
    saved: list = field(default_factory=list)
    bookmarks: list = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> LocalState:
        """The state at a path; an empty one if there is none or it cannot be read."""
        try:
            with open(path, encoding="utf-8") as f:
                data = json.load(f)
            return cls(path, **{k: list(data.get(k, []))[:n] for k, n in KEPT.items()})
        except (OSError, ValueError, AttributeError, TypeError):
            return cls(path)

    def add(self, kind: str, entry) -> None:
        """Put an entry first in its list; an equal one further down goes."""
        entries = getattr(self, kind)
        entries[:] = [entry, *(e for e in entries if e != entry)][: KEPT[kind]]

    def remove(self, kind: str, entry) -> None:
        entries = getattr(self, kind)
        entries[:] = [e for e in entries if e != entry]

    def save(self) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        data = {k: v for k, v in asdict(self).items() if k != "path"}
        with open(self.path + ".new", "w", encoding="utf-8") as f:
            json.dump(data, f, ensure_ascii=False)
        os.replace(self.path + ".new", self.path)
