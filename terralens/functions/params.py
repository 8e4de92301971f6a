"""Parameters of queries, checked before a plan is made."""

from __future__ import annotations

from datetime import datetime, timezone


def instant(text: str | None) -> int | None:
    """Seconds since 1970 of an ISO time: ``Z`` allowed, a blank before the offset read as ``+``, no zone meaning UTC."""
    if not text:
        return None
    t = text.strip().replace("Z", "+00:00").replace("z", "+00:00")
    head, _, tail = t.rpartition(" ")
    if head and "T" in head and ":" in tail:
        t = f"{head}+{tail}"
    at = datetime.fromisoformat(t)
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())


def choice(text: str | None, allowed: set[str]) -> list[str] | None:
    """Entries of a comma list, all of which must be allowed; None for none."""
    values = [v.strip() for v in (text or "").split(",") if v.strip()]
    if unknown := set(values) - allowed:
        raise ValueError(f"unknown: {sorted(unknown)}")
    return values or None


def window_start(now_s: int, hours: int = 72, ttl_s: int = 120) -> int:
    """Start of the default window: now, snapped down so that calls within ``ttl_s`` share a key, minus ``hours``."""
    return now_s - now_s % ttl_s - hours * 3600


def cursor(text: str | None) -> tuple[int, int] | None:
    """``id@iso`` as ``(seconds, id)``; None without a cursor or for id 0."""
    if not text:
        return None
    key, _, at = text.partition("@")
    return None if int(key) == 0 else (instant(at) or 0, int(key))


def split_slots(waiting: dict[str, int], slots: int) -> dict[str, int]:
    """Slots for each queue in proportion to what waits, none above it, none that waits left without while slots last."""
    out = {k: 0 for k in waiting}
    for k in sorted((k for k, n in waiting.items() if n > 0), key=lambda k: (-waiting[k], k))[:slots]:
        out[k] = 1
    while sum(out.values()) < slots and any(out[k] < n for k, n in waiting.items()):
        k = max((k for k, n in waiting.items() if out[k] < n), key=lambda k: (waiting[k] / (out[k] + 1), k))
        out[k] += 1
    return out
