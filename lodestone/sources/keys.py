"""Keys by name: created once, rotated in two steps, with a bounded history of rotations."""

from __future__ import annotations

import base64
import json
import os
from dataclasses import dataclass
from pathlib import Path

from .sync import new_key


@dataclass(frozen=True)
class Rotation:
    """A rotation under way: re-encrypt with (old, new), then commit or abort."""

    name: str
    old: bytes
    new: bytes

    @property
    def pending(self) -> str:
        return f"{self.name}_rotating"


@dataclass
class KeyStore:
    """Keys in one file that only its owner may read; the driver holds them, executors get the one they need.

    A new key stands under a temporary name until the rotation is committed, so that an interrupted one loses neither key.
    """

    path: str
    archive: int = 10

    def _load(self) -> dict:
        try:
            return json.loads(Path(self.path).read_text())
        except FileNotFoundError:
            return {"keys": {}, "history": []}

    def _save(self, data: dict) -> None:
        part = f"{self.path}.part"
        with open(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
            json.dump(data, f)
        os.replace(part, self.path)

    def put(self, name: str, key: bytes) -> None:
        data = self._load()
        data["keys"][name] = base64.b64encode(key).decode()
        self._save(data)

    def get(self, name: str) -> bytes | None:
        found = self._load()["keys"].get(name)
        return None if not found else base64.b64decode(found)

    def exists(self, name: str) -> bool:
        return self.get(name) is not None

    def delete(self, name: str) -> None:
        data = self._load()
        data["keys"].pop(name, None)
        self._save(data)

    def get_or_create(self, name: str) -> bytes:
        key = self.get(name)
        if key is None:
            key = new_key()
            self.put(name, key)
        return key

    def rotate(self, name: str) -> Rotation:
        old = self.get(name)
        if old is None:
            raise KeyError(name)
        rotation = Rotation(name, old, new_key())
        self.put(rotation.pending, rotation.new)
        return rotation

    def commit(self, rotation: Rotation, at: str, entries: int, reason: str) -> None:
        """Makes the new key the current one, and notes the event; of the events the last `archive` stay."""
        data = self._load()
        data["keys"][rotation.name] = data["keys"].pop(rotation.pending)
        last = data["history"][-1]["generation"] if data["history"] else 0
        data["history"].append({"generation": last + 1, "name": rotation.name, "at": at, "entries": entries, "reason": reason})
        del data["history"][: -self.archive]
        self._save(data)

    def abort(self, rotation: Rotation) -> None:
        self.delete(rotation.pending)

    def history(self) -> list[dict]:
        return self._load()["history"]
