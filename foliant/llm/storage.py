"""Intermediate tables of this package: those of the library."""

from __future__ import annotations

from foliant.sources.staging import cut, delete, drop_others, drop_path, free_name, fresh_path, shared_dir, written

__all__ = ["cut", "delete", "drop_others", "drop_path", "free_name", "fresh_path", "shared_dir", "written"]
