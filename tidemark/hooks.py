"""Hooks: observers of what a session does. They are told, and change nothing.

Hooks are registered by the caller, or found in folders that the caller names;
no folder is searched unasked, as loading a module runs it.
"""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Iterable
from pathlib import Path
from typing import Any


class Hook:
    """What may be overridden; each does nothing."""

    def on_authenticated(self, client: Any, **more: Any) -> None: ...

    def on_list_contents(self, path: str, contents: list[dict], **more: Any) -> None: ...

    def before_download(self, remote_item: Any, local_path: str, **more: Any) -> None: ...

    def after_download(self, remote_item: Any, local_path: str, success: bool, **more: Any) -> None: ...

    def on_event(self, name: str, **payload: Any) -> None: ...


class Registry:
    """Hooks in the order in which they came."""

    def __init__(self, hooks: Iterable[Hook] = ()):
        self._hooks = list(hooks)
        self.errors = 0

    @property
    def hooks(self) -> list[Hook]:
        return list(self._hooks)

    def register(self, hook: Hook) -> None:
        self._hooks.append(hook)

    def load(self, folders: Iterable[str]) -> None:
        """The first hook class of each module in the folders that exist, each folder once; a module that fails is left out and counted."""
        for folder in dict.fromkeys(Path(f).expanduser().resolve() for f in folders):
            for file in sorted(folder.glob("*.py")) if folder.is_dir() else []:
                try:
                    spec = importlib.util.spec_from_file_location(f"_tidemark_hook_{abs(hash(file))}_{file.stem}", file)
                    module = importlib.util.module_from_spec(spec)
                    spec.loader.exec_module(module)
                    own = [c for c in vars(module).values() if inspect.isclass(c) and issubclass(c, Hook) and c is not Hook]
                    if own:
                        self.register(own[0]())
                except Exception:
                    self.errors += 1

    def dispatch(self, name: str, *args: Any, **more: Any) -> None:
        """Tell every hook in turn; one that fails doesn't keep the others from being told."""
        for h in self._hooks:
            f = getattr(h, name, None)
            if f is None:
                continue
            try:
                f(*args, **more)
            except Exception:
                self.errors += 1


class IndexHook(Hook):
    """Appends name and local path of each file that was transferred to a text file."""

    def __init__(self, file: str):
        self.file = file

    def after_download(self, remote_item: Any, local_path: str, success: bool, **more: Any) -> None:
        if success:
            with open(self.file, "a") as f:
                f.write(f"{getattr(remote_item, 'name', remote_item)}\t{local_path}\n")
