"""Settings of a crawl over a snapshot."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from gossamer.operators.custom_fields import CustomField
from gossamer.operators.extract import Flags
from gossamer.operators.gates import Scope

STRATEGIES = ("breadth-first",)


@dataclass(frozen=True)
class CrawlConfig:
    """Validated on construction; an unknown name in ``load`` is an error."""

    max_depth: int = 3
    max_seconds: float | None = None
    strategy: str = "breadth-first"
    scope: Scope = Scope()
    flags: Flags = Flags()
    extension_match: tuple[str, ...] = ()
    extension_deny: tuple[str, ...] = ()
    extension_defaults: bool = True
    ignore_query: bool = False
    path_climb: bool = False
    follow_redirects: bool = True
    known_files: str = ""
    unique_content: bool = True
    show_out_of_scope: bool = False
    max_body: int = 4 * 1024 * 1024
    custom_fields: tuple[CustomField, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.strategy == "depth-first":
            raise ValueError("only breadth-first is a defined order over a snapshot")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.max_depth < 0 and not self.max_seconds:
            raise ValueError("a depth or a duration is needed")
        if self.known_files not in ("", "all", "robotstxt", "sitemapxml"):
            raise ValueError(f"unknown known files {self.known_files!r}")
        if self.known_files and self.max_depth < 3:
            object.__setattr__(self, "max_depth", 3)


def load(path: str, base: CrawlConfig = CrawlConfig()) -> CrawlConfig:
    """Settings of a YAML file over the given ones."""
    import yaml

    with open(path) as f:
        given = yaml.safe_load(f) or {}
    known = {x.name for x in fields(CrawlConfig)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    if isinstance(given.get("scope"), dict):
        given["scope"] = Scope(**{k: tuple(v) if isinstance(v, list) else v for k, v in given["scope"].items()})
    if isinstance(given.get("flags"), dict):
        given["flags"] = Flags(**given["flags"])
    if "custom_fields" in given:
        given["custom_fields"] = tuple(CustomField(r["name"], tuple(r["regex"]), r.get("part", "response"), r.get("group", 0)) for r in given["custom_fields"])
    return replace(base, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def headers(lines: list[str]) -> dict[str, str]:
    """'name: value' lines as a map; lines without a colon are left out."""
    return {k.strip(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}
