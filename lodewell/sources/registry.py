"""Which workspaces have an index: a link for each in a folder of the user's, named by a hash of the path."""

from __future__ import annotations

import os
import shutil

#: Of an index, in its workspace.
FOLDER = ".lodewell"


def path_key(path: str) -> str:
    """djb2 of the path's bytes, 16 hexadecimal digits: what functions.hashing.path_key gives of a column."""
    h = 5381
    for b in path.encode():
        h = (h * 33 + b) % (1 << 64)
    return f"{h:016x}"


class Registry:
    def __init__(self, base: str | None = None):
        data = os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share")
        self.base = base or os.path.join(data, "lodewell", "registry")

    def _link(self, root: str) -> str:
        return os.path.join(self.base, path_key(root))

    def add(self, root: str) -> str:
        """The folder of the workspace's index, made and registered if need be. A registry that can't be written is no error."""
        at = os.path.join(root, FOLDER)
        os.makedirs(at, exist_ok=True)
        try:
            os.makedirs(self.base, exist_ok=True)
            if not os.path.lexists(self._link(root)):
                os.symlink(at, self._link(root))
        except OSError:
            pass
        return at

    def remove(self, root: str) -> None:
        """Deletes the workspace's index and its entry."""
        shutil.rmtree(os.path.join(root, FOLDER), ignore_errors=True)
        if os.path.lexists(self._link(root)):
            os.remove(self._link(root))

    def all(self) -> list[str]:
        """Folders of the indexes that are there."""
        links = [os.path.join(self.base, n) for n in sorted(os.listdir(self.base))] if os.path.isdir(self.base) else []
        return [os.path.realpath(x) for x in links if os.path.exists(x)]

    def gc(self) -> int:
        """Drops entries whose workspace is gone; says how many."""
        links = [os.path.join(self.base, n) for n in os.listdir(self.base)] if os.path.isdir(self.base) else []
        gone = [x for x in links if os.path.islink(x) and not os.path.exists(x)]
        for x in gone:
            os.remove(x)
        return len(gone)
