"""Settings as a JSON file: load, save, change in part."""

from __future__ import annotations

import json
from pathlib import Path

LANGUAGES = ("en", "ru")


def load(path: str | Path) -> dict:
    p = Path(path)
    return json.loads(p.read_text(encoding="utf-8")) if p.exists() else {}


def save(path: str | Path, settings: dict) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(settings, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def update(path: str | Path, change: dict) -> dict:
    """Merges nested keys; None removes one."""

    def merge(a: dict, b: dict) -> dict:
        out = dict(a)
        for k, v in b.items():
            if v is None:
                out.pop(k, None)
            else:
                out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
        return out

    now = merge(load(path), change)
    save(path, now)
    return now


def ui_language(value: str | None) -> str | None:
    """The primary tag, if the interface speaks it."""
    tag = (value or "").casefold().replace("_", "-").split("-")[0]
    return tag if tag in LANGUAGES else None


def resolve_language(setting: str | None, indexed: str | None, locale: str | None) -> str:
    return next((t for t in map(ui_language, (setting, indexed, locale)) if t), "en")
