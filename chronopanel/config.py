"""Settings of a run. Only settings that are read exist."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

#: Sections and settings of other configuration files that have no effect here: network access, browser, extractors.
UNUSED = {
    "": ("extract", "visual", "archive"), "crawl": ("mode", "timeout_seconds", "retries", "user_agent", "throttle_seconds"),
    "selection": ("target_date_strategy", "prefer", "event_year_precision_note"),
}


@dataclass
class Timepoints:
    """Names of the timepoints and their offsets to the event's year."""

    relative: list[str] = field(default_factory=lambda: ["pre_pre_event", "pre_event", "event", "post_event", "post_post_event"])
    year_offsets: dict[str, int] = field(default_factory=lambda: {"pre_pre_event": -4, "pre_event": -2, "event": 0, "post_event": 2, "post_post_event": 4})


@dataclass
class Selection:
    """How the capture of an observation is chosen. ``tie_break``: ``later`` or ``earlier`` at equal distance."""

    target_month_day: str = "07-01"
    tolerance_days: int = 548
    tie_break: str = "later"
    allowed_status_codes: list[str] = field(default_factory=lambda: ["200"])
    allowed_mimetypes: list[str] = field(default_factory=lambda: ["text/html"])
    # Addresses under which a site is looked up.
    url_variants: list[str] = field(default_factory=lambda: ["https://www.{domain}/", "http://www.{domain}/", "https://{domain}/", "http://{domain}/"])


@dataclass
class Crawl:
    """Bounds and order of a site's traversal."""

    homepage_only: bool = False
    max_pages_per_snapshot: int = 25
    max_depth: int = 2
    max_response_bytes: int = 10 * 1024 * 1024
    strip_query_strings: bool = False
    exclude_query_patterns: list[str] = field(default_factory=lambda: ["utm_", "fbclid", "gclid"])
    extract_pdf: bool = False
    prefer_german_paths: bool = True
    # Path patterns in order of weight.
    branding_path_patterns: dict[str, list[str]] = field(
        default_factory=lambda: {
            "de": "ueber-uns über-uns unternehmen geschichte historie tradition familie werte verantwortung management geschaeftsfuehrung geschäftsführung karriere presse news".split(),
            "en": "about company history heritage family values responsibility management leadership careers press news".split(),
        }
    )


@dataclass
class Quality:
    """Thresholds of the page checks, size of the review sample."""

    max_temporal_distance_days: int = 548
    min_text_chars: int = 50
    manual_validation_sample_size: int = 15


@dataclass
class Config:
    """All settings. ``run_date`` (ISO) is what counts as today."""

    run_id: str = "run"
    run_date: str = "2026-07-13"
    top_n: int = 5
    input_csv: str | None = None
    output_dir: str = "out"
    interim_dir: str = "interim"
    reports_dir: str = "reports"
    timepoints: Timepoints = field(default_factory=Timepoints)
    selection: Selection = field(default_factory=Selection)
    crawl: Crawl = field(default_factory=Crawl)
    quality: Quality = field(default_factory=Quality)

    @classmethod
    def from_dict(cls, values: dict[str, Any] | None) -> Config:
        """Settings from a dictionary. The section ``run`` holds settings of the top level, ``snapshot_selection`` is ``selection``, and in ``crawl``
        the mode ``homepage_only`` is read. Missing and null values take defaults;
        known settings without effect are ignored, unknown ones warned of."""
        own = {k: v for k, v in (values or {}).items() if k not in ("run", "snapshot_selection")}
        own |= {k: v for k, v in ((values or {}).get("run") or {}).items()}
        if (values or {}).get("snapshot_selection"):
            own["selection"] = dict(values["snapshot_selection"])
        if isinstance(own.get("crawl"), dict) and own["crawl"].get("mode") == "homepage_only":
            own["crawl"] = {**own["crawl"], "homepage_only": True}
        return _fill(cls, own, "")

    @classmethod
    def from_yaml(cls, path: str | Path) -> Config:
        """Settings from a YAML file, see :meth:`from_dict`."""
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")))

    def resolve(self, root: str | Path) -> Config:
        """Make all paths absolute against ``root``."""
        for name in ("input_csv", "output_dir", "interim_dir", "reports_dir"):
            path = getattr(self, name)
            if path is not None:
                setattr(self, name, str((Path(root) / path).resolve()))
        return self


def _fill(cls: type, values: dict[str, Any], section: str) -> Any:
    out = cls()
    known = {f.name for f in fields(cls)}
    odd = sorted(set(values) - known - set(UNUSED.get(section, ())))
    if odd:
        warnings.warn(f"unknown settings in {section or 'the top level'}: {', '.join(odd)}", stacklevel=3)
    for name in known & set(values):
        if values[name] is not None:
            own = getattr(out, name)
            setattr(out, name, _fill(type(own), values[name], name) if is_dataclass(own) else values[name])
    return out
