"""What a search is asked to do, checked before anything runs."""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, field


class ConfigurationError(ValueError):
    """A search that cannot be run as it was asked for."""


@dataclass(frozen=True)
class SafetyLimits:
    """Bounds that archives must keep before any member is decompressed (the defaults are fixed values)."""

    max_members: int = 100_000
    max_member_bytes: int = 512 << 20
    max_total_bytes: int = 2 << 30
    max_compression_ratio: float = 200.0
    max_nested_depth: int = 2


@dataclass(frozen=True)
class SearchOptions:
    """A search. Exactly one of the modes literal (default), regex, smart and advanced holds."""

    patterns: tuple[str, ...] = ()
    regex: bool = False
    smart: bool = False
    advanced: str | None = None
    case_sensitive: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    max_matches: int = 1000
    context: int = 0
    encoding: str = "auto"
    limits: SafetyLimits = field(default_factory=SafetyLimits)
    #: exact: NFKC and full case folding through an Arrow UDF; fast: JVM functions only, the same for text that NFKC leaves as it is
    unicode: str = "exact"

    @property
    def mode(self) -> str:
        return "advanced" if self.advanced is not None else "smart" if self.smart else "regex" if self.regex else "literal"

    def check(self) -> SearchOptions:
        if self.regex and self.smart:
            raise ConfigurationError("smart and regex searches exclude each other")
        if self.advanced is not None:
            if self.regex:
                raise ConfigurationError("advanced and regex searches exclude each other")
            from .operators.advanced import parse

            parse(self.advanced)
        elif not self.patterns:
            raise ConfigurationError("at least one search pattern is required")
        for p in self.patterns:
            if not p:
                raise ConfigurationError("patterns cannot be empty")
            if self.regex:
                try:
                    re.compile(p)
                except re.error as e:
                    raise ConfigurationError(f"invalid regular expression {p!r}: {e}") from e
        if self.smart and self.advanced is None:
            from .functions.text import normalize_text

            if not all(normalize_text(p) for p in self.patterns):
                raise ConfigurationError("smart patterns need a letter or digit")
        if self.max_matches < 1:
            raise ConfigurationError("max_matches must be at least 1")
        if self.context < 0 or self.limits.max_nested_depth < 0:
            raise ConfigurationError("context and nested depth cannot be negative")
        if self.limits.max_compression_ratio <= 0:
            raise ConfigurationError("the compression ratio must be positive")
        if self.unicode not in ("exact", "fast"):
            raise ConfigurationError("unicode is exact or fast")
        if self.encoding != "auto":
            try:
                codecs.lookup(self.encoding)
            except LookupError as e:
                raise ConfigurationError(f"unknown encoding {self.encoding!r}") from e
        return self
