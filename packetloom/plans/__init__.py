"""Named queries over the test tables, grouped by area."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{mod}")
