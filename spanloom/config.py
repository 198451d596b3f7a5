"""Thresholds and palettes, passed explicitly to operators that take them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    line_gap: float = 8.0
    hit_overlap: float = 0.15
    min_image_area: float = 25.0
    word_gap: int = 3
    context_chars: int = 160
    context_words: int = 20
    match_score: float = 0.58
    confident_score: float = 0.86
    top_k: int = 8
    top_k_short: int = 80
    back_container: float = 0.06
    back_offset: float = 0.03
    forward: float = 0.02
    refine_window: int = 900
    refine_radius: int = 20
    max_member_bytes: int = 100 * 1024 * 1024
    max_total_bytes: int = 500 * 1024 * 1024


DEFAULT = Config()

# Method bonuses.
METHOD_BONUS = {"exact": 0.14, "line_hyphen": 0.12, "raw_regex": 0.10, "repaired_regex": 0.08, "anchor": 0.05}

# What a damaged glyph may stand for, in order of preference.
SUBSTITUTIONS = {
    "�": ["fi", "ff", "fl", "ffi", "ffl"], "\x00": ["fi", "ff", "fl", "ffi", "ffl"], "\x14": ["fi", "ff", "fl", "ffi", "ffl"], "\x17": ["fi", "ff", "fl", "ffi", "ffl"],
    "\x10": ["fi", "ff", "fl"], "\x12": ["ff", "fi", "fl"], "\x13": ["fl", "fi", "ff"], "\x15": ["ffi", "fi"], "\x16": ["ffl", "fl"],
    "\x18": ["fi"], "\x19": ["fi"], "\x1a": ["fi"], "\x1b": ["fi"], "\x1c": ["fi"], "\x1d": ["fi"], "\x1e": ["fi"], "\x1f": ["fi"],
    "6": ["fi", "ff", "fl", "ffi", "ffl"], "5": ["fi", "fl", "ffi"], "I": ["ff", "f", "ffi"], "M": ["ffi", "ff", "fi"], "T": ["ffl", "fl"], "X": ["fl", "ffl"], "/": ["Fl", "fl"],
}

# Prefixes after which a hyphen at a line's end belongs to a compound.
COMPOUND_PREFIXES = ("in", "out", "buy", "sell", "call", "put", "long", "short")

# Quotes and dashes to ASCII, odd spaces to space, zero-width and soft hyphen away.
CURLY = "‘’‚‛“”„‟–—−   ​­"
PLAIN = "''''\"\"\"\"---   "
