"""Settings: nested dicts with dotted keys, compiled to the list of enabled steps."""

from __future__ import annotations

import copy
import json
import logging
from pathlib import Path
from typing import Any

import yaml

log = logging.getLogger(__name__)

#: Step -> (key that switches it, default).
SWITCHES = {
    "standardize_lists": ("structure.preserve_lists", True),  # runs if this is off
    "format_headings": ("structure.preserve_headings", True),
    "remove_headers_footers": ("cleaning.remove_headers_footers", True),
    "remove_footnotes": ("cleaning.remove_footnotes", False),
    "clean_whitespace": ("cleaning.clean_whitespace", True),
    "join_paragraph_lines": ("cleaning.join_paragraph_lines", True),
    "remove_duplicates": ("cleaning.remove_duplicate_content", True),
    "remove_boilerplate_text": ("cleaning.remove_boilerplate", True),
    "merge_short_paragraphs": ("cleaning.merge_short_paragraphs", True),
    "normalize_unicode": ("cleaning.normalize_unicode", True),
    "strip_text": ("cleaning.enabled", True),
    "simplify_text": ("optimization.use_abbreviations", False),
    "domain_terms": ("optimization.domain_abbreviations", []),
    "simplify_vocabulary": ("optimization.simplify_vocabulary", False),
    "remove_redundant_phrases": ("optimization.remove_redundant_phrases", True),
    "condense_repetitive_patterns": ("optimization.condense_repetitive_patterns", True),
    "remove_excessive_punctuation": ("optimization.remove_excessive_punctuation", True),
    "simplify_citations": ("optimization.simplify_citations", True),
    "simplify_urls": ("optimization.simplify_urls", False),
    "optimize_line_length": ("optimization.max_line_length", 0),
}
PRESETS = {
    "gpt4": (8192, "General use with large chat models"),
    "claude": (100_000, "Long contexts"),
    "llama": (4096, "Open models with short contexts"),
    "chatgpt": (4096, "Chat models with short contexts"),
    "rag": (2048, "Chunks for retrieval"),
    "minimal": (16_384, "As few changes as can be"),
}
#: What a preset switches besides its limit.
PRESET_STEPS = {
    "claude": {"structure": {"preserve_lists": True}},
    "llama": {"optimization": {"simplify_urls": True, "use_abbreviations": True}},
    "rag": {"cleaning": {"remove_footnotes": True}},
    "minimal": {"cleaning": {"remove_duplicates": False, "remove_headers_footers": False}, "optimization": {"enabled": False}},
}
LEVELS = {
    "minimal": {"structure": {"preserve_headings": False}, "optimization": {"enabled": False}},
    "standard": {},
    "aggressive": {"optimization": {"use_abbreviations": True, "simplify_urls": True}, "cleaning": {"remove_footnotes": True}},
}


def merge(base: dict, over: dict) -> dict:
    """Nested dicts merged; what isn't a dict on both sides is replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


class Config:
    """``compat``: also read processors.content_cleaner.* and processors.content_optimizer.*, which changes results."""

    def __init__(self, values: dict | None = None, compat: bool = False):
        self.values = copy.deepcopy(values or {})
        if compat:
            old = self.values.get("processors", {})
            for name, to in (("content_cleaner", "cleaning"), ("content_optimizer", "optimization")):
                self.values[to] = merge(old.get(name, {}), self.values.get(to, {}))

    def get(self, key: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def section(self, key: str) -> dict:
        got = self.get(key, {})
        return got if isinstance(got, dict) else {}

    def set(self, key: str, value: Any) -> None:
        at = self.values
        *path, last = key.split(".")
        for part in path:
            if not isinstance(at.get(part), dict):
                at[part] = {}
            at = at[part]
        at[last] = value

    @classmethod
    def load(cls, path: str, compat: bool = False) -> Config:
        text = Path(path).read_text(encoding="utf-8")
        return cls((json.loads(text) if path.endswith(".json") else yaml.safe_load(text)) or {}, compat)

    def save(self, path: str) -> None:
        Path(path).write_text(yaml.safe_dump(self.values, sort_keys=False, allow_unicode=True), encoding="utf-8")

    def steps(self) -> list[str]:
        """Enabled steps, in order."""
        out = []
        for step, (key, default) in SWITCHES.items():
            if not self.get(key.split(".")[0] + ".enabled", True):
                continue
            if key.startswith("optimization.") and self.get("processing.cleaning_level", "standard") == "minimal":
                continue
            value = self.get(key, default)
            if bool(value) != (step == "standardize_lists"):
                out.append(step)
        return out


def preset(name: str) -> Config:
    if name not in PRESETS:
        raise ValueError(f"unknown preset: {name}; there are {', '.join(sorted(PRESETS))}")
    return Config(merge({"general": {"preset": name, "token_limit": PRESETS[name][0]}}, PRESET_STEPS.get(name, {})))


def create(kind: str = "standard", overrides: dict | None = None) -> Config:
    """A preset or level with overrides (nested, or flat with dotted keys). Presets' names win; unknown kinds are standard."""
    if kind in PRESETS:
        c = preset(kind)
    else:
        if kind not in LEVELS:
            log.warning("unknown configuration %s: standard", kind)
        c = Config(LEVELS.get(kind, {}))
    for k, v in (overrides or {}).items():
        if "." in k:
            c.set(k, v)
        elif isinstance(v, dict):
            c.values[k] = merge(c.section(k), v)
        else:
            c.values[k] = v
    return c


def option(text: str) -> tuple[str, Any]:
    """``key=value`` with booleans and numbers read as such."""
    if "=" not in text:
        raise ValueError(f"not key=value: {text}")
    k, v = (x.strip() for x in text.split("=", 1))
    if v.lower() in ("true", "false"):
        return k, v.lower() == "true"
    for kind in (int, float):
        try:
            return k, kind(v)
        except ValueError:
            pass
    return k, v
