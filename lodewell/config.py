"""Settings, read from and written to TOML."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from .errors import ConfigError


@dataclass
class IndexSettings:
    reindex_interval_minutes: int = 10
    extensions: list[str] = field(default_factory=lambda: ["rs", "py", "ts", "go", "c", "h", "md", "yaml", "yml", "bzl"])
    embed_workers: int = 4
    max_file_bytes: int = 1_048_576
    workspaces: list[str] = field(default_factory=list)


@dataclass
class ModelSettings:
    dir: str = ""


@dataclass
class SearchSettings:
    top_k: int = 5
    min_score: float = 0.65
    mmr_lambda: float = 0.8
    bm25_weight: float = 0.5


@dataclass
class Settings:
    index: IndexSettings = field(default_factory=IndexSettings)
    model: ModelSettings = field(default_factory=ModelSettings)
    search: SearchSettings = field(default_factory=SearchSettings)

    #: Keys that a section may leave out; of all others a section that is there must have every one.
    OPTIONAL = {"mmr_lambda", "bm25_weight", "workspaces"}

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """Defaults if there is no file or a section is absent; an error if a section lacks a key or the file can't be read."""
        path = Path(path)
        if not path.exists():
            return cls()
        try:
            raw = tomllib.loads(path.read_text())
        except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
            raise ConfigError(str(e)) from e
        out = cls()
        for section in dataclasses.fields(cls):
            if section.name not in raw:
                continue
            kind, given = type(getattr(out, section.name)), raw[section.name]
            names = {f.name for f in dataclasses.fields(kind)}
            if lacking := names - given.keys() - cls.OPTIONAL:
                raise ConfigError(f"[{section.name}] lacks {', '.join(sorted(lacking))}")
            setattr(out, section.name, kind(**{k: v for k, v in given.items() if k in names}))
        return out

    def save(self, path: str | Path) -> None:
        def shown(v) -> str:
            if isinstance(v, str):
                return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
            return "[" + ", ".join(map(shown, v)) + "]" if isinstance(v, list) else str(v)

        parts = [f"[{s}]\n" + "".join(f"{k} = {shown(v)}\n" for k, v in dataclasses.asdict(getattr(self, s)).items()) for s in ("index", "model", "search")]
        Path(path).write_text("\n".join(parts))


def expand_home(path: str, home: str) -> str:
    return home.rstrip("/") + path[1:] if path == "~" or path.startswith("~/") else path


def portable(path: str, home: str) -> str:
    home = home.rstrip("/")
    return "~" + path[len(home) :] if path == home or path.startswith(home + "/") else path
