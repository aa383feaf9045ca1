"""Settings read from the environment's text, with the checks that a deployment needs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


def positive(settings: Mapping[str, str], name: str, default: int, most: int = 1 << 31) -> int:
    """A whole number above 0, or the default where nothing is set."""
    text = (settings.get(name) or "").strip()
    if not text:
        return default
    if not text.isdecimal() or not 0 < int(text) <= most:
        raise ValueError(f"{name} is a whole number from 1 to {most}")
    return int(text)


def together(settings: Mapping[str, str], names: tuple[str, ...]) -> dict[str, str] | None:
    """The settings of a group: all of them, or None where none is set."""
    found = {n: (settings.get(n) or "").strip() for n in names}
    given = [n for n, v in found.items() if v]
    if given and len(given) < len(names):
        raise ValueError(f"{', '.join(n for n in names if n not in given)} must be set with {', '.join(given)}")
    return found if given else None


@dataclass(frozen=True)
class Limits:
    """Requests a minute."""

    search: int = 10
    fetch: int = 20

    @classmethod
    def of(cls, settings: Mapping[str, str]) -> Limits:
        return cls(positive(settings, "RATE_LIMIT_SEARCH_PER_MIN", cls.search), positive(settings, "RATE_LIMIT_FETCH_PER_MIN", cls.fetch))


def envelope(text: str, structured: dict | None = None, error: bool = False) -> dict:
    """What an operation returns for one request: a text, and its data beside it."""
    out: dict = {"content": [{"type": "text", "text": text}]}
    if structured is not None:
        out["structuredContent"] = structured
    return out | {"isError": True} if error else out


def rate_limited(tool: str, setting: str, limit: int, retry_ms: int) -> dict:
    return envelope(f"Rate limit exceeded for {tool}: {limit} requests per minute ({setting}). Try again in {-(-retry_ms // 1000)} s.", error=True)
