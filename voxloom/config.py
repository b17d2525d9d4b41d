"""Settings read from files, as dataclasses."""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Mapping
from pathlib import Path
from typing import Any, TypeVar

T = TypeVar("T")


def _fitted(kind: Any, value: Any) -> Any:
    """A value in its field's type, as far as files can't say it: paths, tuples, and settings within settings; null stays."""
    if value is None:
        return None
    kinds = [k for k in (typing.get_args(kind) or (kind,)) if k is not type(None)]
    if dataclasses.is_dataclass(kinds[0]) and isinstance(value, Mapping):
        return from_mapping(kinds[0], value)
    if Path in kinds:
        return Path(value)
    return tuple(value) if typing.get_origin(kind) is tuple and isinstance(value, list) else value


def from_mapping(cls: type[T], raw: Mapping[str, Any] | None) -> T:
    """cls from what a settings file gives: keys that it doesn't have are dropped, what is missing keeps its default."""
    kinds = typing.get_type_hints(cls)
    own = {f.name for f in dataclasses.fields(cls)}
    return cls(**{k: _fitted(kinds[k], v) for k, v in (raw or {}).items() if k in own})
