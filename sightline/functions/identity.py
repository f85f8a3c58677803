"""Identity of images from their file names: export suffix, clip and group key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The naming patterns that say which frames come from one clip.
EXPORT_SUFFIX = r"(?id)_(?:jpe?g|png|bmp|webp|tiff?)\.rf\.[0-9a-f]{32}$"
CLIP_PATTERNS = (
    r"(?id)^(.+?)[-_](?:mp4|avi|mov|mkv|webm)[-_]t[-_]\d+$",
    r"(?id)^(.*\bvideo\d+)_\d+$",
    r"(?id)^(.+?)[-_]?frame[-_]?\d+$",
)
#: Folders of a multi-split export.
UPSTREAM_DIRS = ("train", "valid", "val", "test")


def strip_export_suffix(name: Column) -> Column:
    """``name`` without a trailing ``_<ext>.rf.<32 hex digits>``; null stays null."""
    return F.regexp_replace(name, EXPORT_SUFFIX, "")


def clip_id(name: Column) -> Column:
    """The clip that a frame's name tells, as it is spelled; null for stills and for null."""
    base = strip_export_suffix(name)
    return F.coalesce(*(F.nullif(F.regexp_extract(base, p, 1), F.lit("")) for p in CLIP_PATTERNS))


def group_key(image_id: Column, group: Column) -> Column:
    """What must stay in one split: the explicit group (an empty one counts), else the clip, else the bare name."""
    return F.coalesce(group, clip_id(image_id), F.nullif(strip_export_suffix(image_id), F.lit("")), image_id)


def split_export_id(image_id: Column, prefixes: list[str]) -> tuple[Column, Column]:
    """(prefix, stem) of ids like ``<prefix><train|valid|val|test>-<stem>``; nulls where the id has another form."""
    one = "|".join(sorted((_quote(p) for p in set(prefixes)), key=len, reverse=True)) or "(?!)"
    pattern = rf"(?sd)^({one})(?:{'|'.join(UPSTREAM_DIRS)})-(.+)$"
    hit = image_id.rlike(pattern)
    return F.when(hit, F.regexp_extract(image_id, pattern, 1)), F.when(hit, F.regexp_extract(image_id, pattern, 2))


def _quote(s: str) -> str:
    return "".join(c if c.isalnum() or c in "-_" else "\\" + c for c in s)
