"""Declarative descriptions of listing boards."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from lodestack.errors import ConfigError
from lodestack.functions.markup import Selector, _compiled
from lodestack.functions.text import TAG_SEPARATORS
from lodestack.functions.urls import template_url, with_query_param


def _strict(cls, data: Any, where: str):
    """An instance of a dataclass from a mapping that may hold its fields only."""
    if not isinstance(data, dict):
        raise ConfigError(f"{where} must be a mapping")
    unknown = set(data) - {f.name for f in fields(cls)}
    if unknown:
        raise ConfigError(f"{where} has unknown settings: {', '.join(sorted(unknown))}")
    try:
        return cls(**data)
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from e


@dataclass
class ListSpec:
    """How to read an index page."""

    item_selector: str
    url: str
    external_id: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    multi_fields: list[str] = field(default_factory=lambda: ["tags"])
    tag_separators: list[str] = field(default_factory=lambda: [*TAG_SEPARATORS])

    def __post_init__(self):
        _compiled(self.item_selector)
        for spec in [self.url, *self.fields.values(), *filter(None, [self.external_id])]:
            Selector.parse(spec)


@dataclass
class DetailSpec:
    """How to read a detail page; its values win over the list's."""

    fields: dict[str, str] = field(default_factory=dict)
    multi_fields: list[str] = field(default_factory=lambda: ["tags"])
    tag_separators: list[str] = field(default_factory=lambda: [*TAG_SEPARATORS])
    remove: str | None = "script, style, noscript"

    def __post_init__(self):
        for spec in self.fields.values():
            Selector.parse(spec)
        if self.remove:
            _compiled(self.remove)


@dataclass
class PaginationSpec:
    """Follow a link to the next page, or make page urls. max_pages None, for links only, follows them to the last page."""

    max_pages: int | None = 3
    next_selector: str | None = None
    page_url: str | None = None
    page_query_param: str | None = None

    def __post_init__(self):
        if self.max_pages is None:
            if not self.next_selector or self.page_url or self.page_query_param:
                raise ConfigError("max_pages may be open only where pages are linked by next_selector alone")
        elif not isinstance(self.max_pages, int) or not 1 <= self.max_pages <= 100:
            raise ConfigError("max_pages must be from 1 to 100")
        if self.next_selector:
            _compiled(self.next_selector)


@dataclass
class BoardConfig:
    name: str
    start_urls: list[str]
    list: ListSpec
    description: str = ""
    detail: DetailSpec | None = None
    pagination: PaginationSpec = field(default_factory=PaginationSpec)
    infer_remote: bool = True
    infer_employment_type: bool = True
    base_url: str | None = None

    def __post_init__(self):
        if not self.start_urls:
            raise ConfigError("start_urls must not be empty")

    @classmethod
    def from_mapping(cls, data: Any) -> BoardConfig:
        if isinstance(data, dict):
            data = dict(data)
            for name, kind in (("list", ListSpec), ("detail", DetailSpec), ("pagination", PaginationSpec)):
                if data.get(name) is not None:
                    data[name] = _strict(kind, data[name], name)
        return _strict(cls, data, "board")

    @classmethod
    def from_yaml(cls, path: str | Path) -> BoardConfig:
        import yaml

        try:
            return cls.from_mapping(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
        except FileNotFoundError as e:
            raise ConfigError(f"no board description at {path}") from e

    @property
    def base(self) -> str:
        return self.base_url or self.start_urls[0]

    def page_url(self, page: int) -> str:
        """Url of a list page, counted from 1."""
        first = self.start_urls[0]
        if self.pagination.page_url:
            return template_url(first, self.pagination.page_url, page)
        if self.pagination.page_query_param:
            return with_query_param(first, self.pagination.page_query_param, page)
        if page > 1:
            raise ConfigError("no way to make urls of further pages is set")
        return first
