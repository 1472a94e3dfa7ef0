"""Shared folder for intermediate tables, as the rest of the library has it."""

from softseg.sources.store import materialise, new_path, shared_dir

__all__ = ["materialise", "new_path", "shared_dir"]
