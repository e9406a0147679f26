"""Known databases, in one small JSON file."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass
from datetime import datetime, timezone


@dataclass
class Database:
    name: str
    path: str
    source_folder: str = ""
    output_folder: str = ""
    created_at: str = ""
    last_indexed: str | None = None


def slug(name: str) -> str:
    return name.strip().lower().replace(" ", "-")


class Registry:
    def __init__(self, path: str | None = None, home: str | None = None):
        self.home = home or os.path.expanduser("~/.graphloom")
        self.path = path or f"{self.home}/registry.json"

    def _load(self) -> dict[str, dict]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path) as f:
            return json.load(f)

    def _save(self, all_: dict[str, dict]) -> None:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        fd, draft = tempfile.mkstemp(dir=os.path.dirname(self.path))
        with os.fdopen(fd, "w") as f:
            json.dump(all_, f, indent=2)
        os.replace(draft, self.path)

    def register(self, name: str, path: str | None = None, source_folder: str = "", output_folder: str = "") -> Database:
        key, all_ = slug(name), self._load()
        base = f"{self.home}/{key}"
        db = Database(key, path or f"{base}/store", source_folder or f"{base}/input", output_folder or f"{base}/output", datetime.now(timezone.utc).isoformat())
        all_[key] = asdict(db)
        self._save(all_)
        return db

    def get(self, name: str | None = None) -> Database:
        """A known database; without a name the one in GRAPHLOOM_DATABASE, or "default", made if need be."""
        key = slug(name or os.environ.get("GRAPHLOOM_DATABASE", "default"))
        known = self._load().get(key)
        if known:
            return Database(**known)
        if name:
            raise KeyError(f"no database {name!r} is registered")
        return self.register(key)

    def names(self) -> list[str]:
        return sorted(self._load())

    def touch(self, name: str) -> None:
        all_ = self._load()
        all_[slug(name)]["last_indexed"] = datetime.now(timezone.utc).isoformat()
        self._save(all_)

    def remove(self, name: str) -> bool:
        all_ = self._load()
        if all_.pop(slug(name), None) is None:
            return False
        self._save(all_)
        return True
