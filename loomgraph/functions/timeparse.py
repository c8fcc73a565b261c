"""Time arguments of a context: epoch numbers, RFC 1123 dates and durations like ``-1m30s``."""

from __future__ import annotations

import re
from email.utils import parsedate_to_datetime

#: Milliseconds of the duration units.
UNITS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6}
#: Larger integers are milliseconds, others seconds.
MAX_SECONDS = 2147483647
NOW = "NOW"
FOREVER = "FOREVER"


def duration_ms(text: str) -> int:
    found = re.fullmatch(r"([+-]?)((?:[0-9]*\.?[0-9]+(?:ns|us|µs|ms|s|m|h))+)", text.strip())
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    total = sum(float(n) * UNITS[u] for n, u in re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", found[2]))
    return int(-total if found[1] == "-" else total)


def instant_ms(at: str | int, now_ms: int) -> int:
    """Epoch milliseconds of an instant; a duration counts from *now_ms*."""
    if isinstance(at, int):
        return at if at > MAX_SECONDS else at * 1000
    if at.upper() == NOW:
        return now_ms
    try:
        return now_ms + duration_ms(at)
    except ValueError:
        return int(parsedate_to_datetime(at).timestamp() * 1000)


def length_ms(duration: str | int) -> int | None:
    """Milliseconds of a context's length; None is without a start."""
    if isinstance(duration, int):
        return duration * 1000
    return None if duration.upper() == FOREVER else abs(duration_ms(duration))
