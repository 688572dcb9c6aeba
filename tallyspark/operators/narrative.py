"""Results in words, and chart descriptions."""

from __future__ import annotations


def change_text(metric: str, base: float | None, current: float | None) -> str:
    """One sentence about a change."""
    if base is None or current is None:
        return f"{metric} can't be compared: a window has no value."
    delta = current - base
    share = f" ({delta / abs(base):+.1%})" if base else ""
    word = "rose" if delta > 0 else "fell" if delta < 0 else "didn't change"
    return f"{metric} {word} from {base:,.2f} to {current:,.2f}{share}." if delta else f"{metric} {word}: it is {current:,.2f}."


def driver_text(rows: list[dict], k: int = 3) -> str:
    """The members that moved the most."""
    best = sorted(rows, key=lambda r: -abs(r["diff"]))[:k]
    return "Largest changes: " + "; ".join(f"{r['member']} {r['diff']:+,.2f}" for r in best) + "." if best else "No member changed."


def waterfall(start: float, effects: dict[str, float], end: float) -> dict:
    """A chart of effects between two totals."""
    bars, at = [{"label": "base", "from": 0.0, "to": start}], start
    for name, x in effects.items():
        bars.append({"label": name, "from": at, "to": at + x})
        at += x
    return {"type": "waterfall", "bars": [*bars, {"label": "current", "from": 0.0, "to": end}], "gap": end - at}


def chart(kind: str, rows: list[dict], x: str, y: str) -> dict:
    """A chart of kind scatter, forecast, funnel, sankey or heatmap over result rows."""
    if kind not in ("scatter", "forecast", "funnel", "sankey", "heatmap", "line", "bar"):
        raise ValueError(f"no chart {kind!r}")
    return {"type": kind, "x": x, "y": y, "data": [{x: r[x], y: r[y]} for r in rows]}
