"""Files beside the data: prompts, models, word lists, checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def load_prompt(folder: str, name: str) -> str:
    """The text of a prompt in a folder; a name that leads out of it is an error."""
    base = Path(folder).resolve()
    path = (base / (name if Path(name).suffix else f"{name}.txt")).resolve()
    if base not in path.parents:
        raise ValueError(f"{name} is not within the prompt folder")
    return path.read_text(encoding="utf-8").strip()


def model_path(name: str, folders: Sequence[str]) -> str:
    """The first folder that has the model; models are never fetched from a network."""
    for folder in folders:
        path = Path(folder) / name
        if path.exists():
            return str(path)
    raise FileNotFoundError(f"no model {name} in {list(folders)}")


def word_list(path: str) -> list[str]:
    """One entry a line, without blanks, comments and repeats, in order."""
    lines = (x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines())
    return list(dict.fromkeys(x for x in lines if x and not x.startswith("#")))


def md5_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


# What a viewer of results needs.


def entity_types(spans: Column) -> Column:
    """The distinct entity types of a note's spans, sorted."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity_type"])))


def recognizers(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["recognizer"])))


def by_recognizer(spans: Column, names: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["recognizer"].isin(list(names)))


def highlights(spans: Column) -> Column:
    """Spans as (start, end, label), by start, for a display of entities in text."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("label"))))
