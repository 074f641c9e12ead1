"""Output places: safe names, conflicts with existing files, and layered options for a run on the driver."""

from __future__ import annotations

import os
import re

from quire.functions.layout import PAGE_SIZES
from quire.operators.paginate import Options

# Signs that file systems refuse, with what replaces them.
REPLACED = {":": " -", "*": "", "?": "", '"': "'", "<": "(", ">": ")", "|": "-", "\\": "-", "/": "-"}
MODES = ("fail", "overwrite", "rename", "skip")


class Exists(Exception):
    """The output exists already and is to be kept."""


def safe_name(name: str) -> str:
    """A file name's stem that any system takes: at most 150 bytes, cut between characters."""
    out = "".join(REPLACED.get(c, c) for c in name).strip().strip(". ") or "book"
    if len(out.encode()) > 150:
        out = out.encode()[:150].decode("utf-8", "ignore").strip()
    return out


def next_free(path: str, taken: set[str] | None = None) -> str:
    stem, ext = os.path.splitext(path)
    free = (p for i in range(2, 1000) if not os.path.exists(p := f"{stem} ({i}){ext}") and p not in (taken or ()))
    return next(free, path)


def output_path(source: str, path: str = "", folder: str = "", suffix: str = "", mode: str = "fail", taken: set[str] | None = None) -> str:
    """Where a book's file goes; one that exists, or is ``taken``, is refused, replaced, kept (``Exists``) or sidestepped by a number."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if not path:
        stem = os.path.splitext(os.path.basename(source))[0]
        path = os.path.join(folder or os.path.dirname(source), safe_name(stem) + suffix + ".pdf")
    if not os.path.splitext(path)[1]:
        path += ".pdf"
    if os.path.exists(path) or path in (taken or ()):
        if mode == "skip":
            raise Exists(path)
        if mode == "rename":
            return next_free(path, taken)
        if mode == "fail":
            raise FileExistsError(path)
    return path


def page_size(name: str) -> tuple[float, float]:
    """Points of a named page, or of WIDTHxHEIGHT in mm (the default), in or pt."""
    key = name.strip().lower()
    if key in PAGE_SIZES or not key:
        return PAGE_SIZES[key or "letter"][1:]
    unit = {"in": 72.0, "pt": 1.0}.get(key[-2:], 72 / 25.4)
    m = re.fullmatch(r"\s*([\d.]+)\s*x\s*([\d.]+)\s*", re.sub(r"(mm|in|pt)\Z", "", key))
    if not m or not (float(m[1]) > 0 and float(m[2]) > 0):
        raise ValueError(f"unknown page size {name!r}")
    return float(m[1]) * unit, float(m[2]) * unit


def _values(layer: dict) -> dict:
    """A layer's settings as option values: sizes by name, margins in mm."""
    out = {k: v for k, v in layer.items() if k in Options.__dataclass_fields__}
    if layer.get("page_size"):
        out["page_w"], out["page_h"] = page_size(layer["page_size"])
    if layer.get("margin_mm") is not None:
        out["margins"] = (layer["margin_mm"] * 72 / 25.4,) * 4
    return out


def options_for(preset: str = "ereader", saved_page: str = "", config: dict | None = None, flags: dict | None = None) -> Options:
    """Preset (with the saved page unless the preset owns its page), then configuration, then flags; clamped once at the end."""
    from quire.plans.corpus import PRESETS

    p = next((x for x in PRESETS if x[0] == preset.strip().lower()), None)
    if p is None:
        raise ValueError(f"unknown preset {preset!r}")
    base = _values({"page_size": p[1] if p[10] else saved_page or "letter", "margin_mm": p[2], "font": p[3], "font_size": p[4], "line_spacing": p[5], "justify": p[6], "title_page": p[7], "page_numbers": p[8], "running_header": p[9]})
    return Options().over(**base).over(**_values(config or {})).over(**_values(flags or {})).normal()


def check_flags(flags: dict) -> None:
    """Refuses settings that contradict each other or lie outside their ranges."""
    if sum(bool(flags.get(k)) for k in ("overwrite", "skip_existing", "auto_rename")) > 1:
        raise ValueError("choose one of overwrite, skip_existing and auto_rename")
    if flags.get("output") and flags.get("output_dir"):
        raise ValueError("choose one of output and output_dir")
    for k, low, high in (("font_size", 5, 40), ("line_spacing", 1, 3), ("margin_mm", 0, 100), ("jobs", 1, 64)):
        v = flags.get(k)
        if v is not None and not low <= v <= high:
            raise ValueError(f"{k} must lie between {low} and {high}")


DEFAULTS = {"preset": "ereader", "output": {"suffix": "", "conflict": "fail"}, "ui": {"theme": "midnight-ink"}}


def _over(base: dict, more: dict) -> dict:
    """``base`` with the values of ``more``, nested settings one by one."""
    return base | {k: _over(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in more.items()}


def load_config(path: str) -> tuple[dict, str | None]:
    """(settings over the defaults, error): a missing file gives the defaults, a damaged one the defaults and the error."""
    if not os.path.exists(path):
        return _over(DEFAULTS, {}), None
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            got = yaml.safe_load(f)
    except Exception as e:
        return _over(DEFAULTS, {}), str(e)
    if got is not None and not isinstance(got, dict):
        return _over(DEFAULTS, {}), "the file holds no settings"
    return _over(DEFAULTS, got or {}), None


def save_config(path: str, settings: dict) -> None:
    """Writes the settings, and the folder where it is missing."""
    import yaml

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(settings, f, allow_unicode=True, sort_keys=True)
