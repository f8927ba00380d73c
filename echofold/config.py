"""Thresholds and limits of an analysis, in one place."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class DedupConfig:
    extensions: tuple[str, ...] = ("py", "js", "ts", "go", "rs", "java", "c", "cpp", "cs", "rb", "php", "sh", "html", "css", "sql", "md")
    exclude: tuple[str, ...] = (".git", "node_modules", "venv", ".venv", "__pycache__", "_site", "*.min.js", "site-packages")
    include_tests: bool = False
    functions_only: bool = True
    min_lines: int = 3
    max_file_kb: int = 1024
    match_threshold: float = 0.85
    fuzzy: bool = False
    fuzzy_threshold: float = 0.80
    minhash_threshold: float = 0.80
    minhash_min_lines: int = 50
    semantic_threshold: float = 0.80
    intent_threshold: float = 0.84
    top_k: int = 10
    gate_groups: int = 10
    gate_lines: int = 100
    state_days: int = 30

    @classmethod
    def layered(cls, *layers: Mapping[str, object], env: Mapping[str, str] = os.environ, prefix: str = "ECHOFOLD_") -> DedupConfig:
        """Defaults, then each mapping in turn, then environment variables."""
        config = cls()
        known = {f.name: f for f in fields(cls)}
        for layer in layers:
            config = replace(config, **{k: v for k, v in layer.items() if k in known})
        said: dict[str, object] = {}
        for name in known:
            raw = env.get(prefix + name.upper())
            if raw is None:
                continue
            now = getattr(config, name)
            if isinstance(now, bool):
                said[name] = raw.lower() in ("1", "true", "yes", "on")
            elif isinstance(now, tuple):
                said[name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            else:
                said[name] = type(now)(raw)
        return replace(config, **said)

    @classmethod
    def from_toml(cls, text: str, **kw) -> DedupConfig:
        import tomllib

        found = tomllib.loads(text)
        return cls.layered(found.get("tool", {}).get("echofold", {}), {k: v for k, v in found.items() if k != "tool"}, **kw)
