"""Sizes, durations, bars and intervals as text, for rendered reports."""

from __future__ import annotations


def format_size(size: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024:
            return f"{int(size)} B" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} TB"


def format_duration(seconds: float) -> str:
    if seconds < 60:
        return f"{seconds:.1f}s"
    minutes, rest = divmod(int(seconds), 60)
    if minutes < 60:
        return f"{minutes}m {rest}s"
    return f"{minutes // 60}h {minutes % 60}m"


def bar(fraction: float, width: int = 20) -> str:
    return "#" * int(fraction * width)


def format_ci(p: float, lo: float, hi: float, n: int, population: int) -> str:
    if n >= population:
        return f"{p * 100:.1f}% (exact, N={population})"
    return f"{p * 100:.1f}% (CI: {lo * 100:.1f}% -- {hi * 100:.1f}%, n={n})"
