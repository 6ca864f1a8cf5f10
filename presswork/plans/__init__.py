"""Named queries over the domain views, each registered with its SQL twin."""

from . import admin, assembly, console, desk, feeds, ingest, people, review, stories, text, upkeep  # noqa: F401
