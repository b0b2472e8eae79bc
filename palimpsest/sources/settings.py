"""Search settings as JSON; a missing or broken file gives the defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, fields
from pathlib import Path

from ..operators.matching import SearchParams


def load(path: str) -> SearchParams:
    try:
        given = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return SearchParams()
    known = {f.name for f in fields(SearchParams)}
    return SearchParams(**{k: v for k, v in given.items() if k in known})


def save(params: SearchParams, path: str) -> None:
    Path(path).write_text(json.dumps(asdict(params), indent=1))
