"""Filter profiles: JSON of named include and exclude patterns."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Profile:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


def parse_profiles(text: str, name: str | None) -> Profile:
    """The profile ``name``; without a name no filters. ValueError for text that isn't JSON, KeyError for an unknown name."""
    if not name:
        return Profile()
    try:
        every = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"profiles aren't JSON: {e}") from e
    if name not in every:
        raise KeyError(f"no profile {name!r}")
    return Profile(tuple(every[name].get("include", [])), tuple(every[name].get("exclude", [])))


def load_profile(path: str, name: str | None) -> Profile:
    """As ``parse_profiles``, from a file; FileNotFoundError if there is none. The file isn't read without a name."""
    return parse_profiles(Path(path).read_text(), name) if name else Profile()
