"""Folder resolution: requested names against a folder relation, in the order requested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER_MIME = "application/vnd.google-apps.folder"


def _live(folders: DataFrame) -> DataFrame:
    """One folder for each name: of several, that with the smallest id."""
    kept = folders.where((F.col("mime_type") == FOLDER_MIME) & ~F.coalesce("trashed", F.lit(False)))
    return kept.groupBy("name").agg(F.min("folder_id").alias("folder_id"))


def found(requested: DataFrame, folders: DataFrame) -> DataFrame:
    """(ord, name, folder_id) of requests (ord, name) with a live folder; repeats stay."""
    return requested.join(_live(folders), "name").select("ord", "name", "folder_id")


def not_found(requested: DataFrame, folders: DataFrame) -> DataFrame:
    return requested.join(_live(folders), "name", "left_anti").select("ord", "name")
