"""Cutoffs: a date, or a span back from now."""

from __future__ import annotations

import datetime as dt
import re
import time

DAY_MS = 86_400_000
_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}
_WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def parse_since(raw: str, now_ms: int | None = None) -> int:
    """Milliseconds since the epoch of `YYYY-MM-DD` (UTC midnight) or of `30d`, `12w`, `6m`, `1y`
    before now; years are 365 days, months 30. Far spans end at the 64-bit limits."""
    t = raw.strip(_WHITE)
    if t and t[-1] in _DAYS:
        if not re.fullmatch(r"-?[0-9]+", t[:-1]):
            raise ValueError(f"invalid span: {t}")
        # Python limits the digits that int() reads; so many are far beyond the clamp anyway.
        digits = t[:-1] if len(t) < 1000 else ("-" if t[0] == "-" else "") + "9" * 999
        now = int(time.time() * 1000) if now_ms is None else now_ms
        return min(max(now - int(digits) * _DAYS[t[-1]] * DAY_MS, _LOW), _HIGH)
    m = re.fullmatch(r"([0-9]{4})-([0-9]{2})-([0-9]{2})", t)
    if m and int(m[1]) >= 100:
        try:
            day = dt.date(*map(int, m.groups()))
            return (day - dt.date(1970, 1, 1)).days * DAY_MS
        except ValueError:
            pass
    raise ValueError(f"invalid date: {t} (expected YYYY-MM-DD or a span like 30d)")
