"""Settings of a search and of a build, checked when they are made."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from folioflow.functions.dates import compact_date


def _count(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v > 0


def _share(v: Any) -> bool:
    return isinstance(v, int | float) and 0.0 <= v <= 1.0


def _texts(v: Any) -> bool:
    return v is None or all(isinstance(x, str) for x in v)


def _day(v: Any) -> bool:
    compact_date(v)
    return True


def _one_of(*names: str) -> Callable[[Any], bool]:
    return lambda v: v in names


#: The names that a settings file may carry, by concern, each with our default, what holds for it, and whether it may be left out.
SEARCH = {"top_k": (10, _count), "rerank_depth": (32, _count), "hybrid_dense_weight": (0.5, _share)}
BUILD = {"corpus_cap": (10_000, _count), "stranded_policy": ("finish_first", _one_of("finish_first", "ignore")), "relevance_filter": ("off", _one_of("off", "embedding"))}
FEED = {"focus_area_queries": ((), lambda v: bool(v) and _texts(v)), "ordering": ("freshest_first", _one_of("freshest_first", "relevance")), "arxiv_categories": (None, _texts), "arxiv_date_from": (None, _day), "arxiv_date_to": (None, _day), "ingest_paper_ids": (None, _texts)}
KNOWN = SEARCH | BUILD | FEED
#: Names that a settings file may carry besides, about a host's files and processes; they are read over.
HOST = ("ingestion_mode", "sources", "child_parent_expansion", "parse_batch_size", "db_path", "blob_dir", "collection", "pdf_cache_dir", "batch_size_log_path", "prefetch_target", "gpu_lock_path")


class Config:
    """Settings as attributes. `focus_area_queries` must be given; a value that doesn't hold is an error, as is an unknown name."""

    def __init__(self, focus_area_queries: tuple[str, ...], **given: Any):
        given["focus_area_queries"] = focus_area_queries
        if unknown := set(given) - set(KNOWN) - set(HOST):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        for name, (default, holds) in KNOWN.items():
            value = given.get(name, default)
            value = tuple(value) if isinstance(value, list) else value
            if not holds(value):
                raise ValueError(f"{name} can't be {value!r}")
            setattr(self, name, value)

    @classmethod
    def of(cls, values: Mapping) -> Config:
        return cls(**{"focus_area_queries": (), **values})

    def overlaid(self, **overrides: Any) -> Config:
        """Overrides replace, but queries are appended, none twice; the result is checked again."""
        more = overrides.pop("focus_area_queries", ())
        own = {name: getattr(self, name) for name in KNOWN}
        own |= {k: v for k, v in overrides.items() if v is not None}
        return Config.of(own | {"focus_area_queries": tuple(dict.fromkeys((*self.focus_area_queries, *more)))})


def load(path: str) -> Config:
    """From a YAML mapping."""
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("reading a settings file takes the yaml package") from e
    with open(path) as f:
        values = yaml.safe_load(f)
    if not isinstance(values, dict):
        raise ValueError("a settings file is a mapping")
    return Config.of(values)
