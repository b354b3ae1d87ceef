"""Colours for states, by rule."""

from __future__ import annotations

import colorsys

#: Hues start here and go round by the golden angle, so that any number of colours stays apart.
START, TURN = 0.58, 0.6180339887498949


def color_palette(n: int, lightness: float = 0.62, saturation: float = 0.55) -> list[str]:
    """n colours as #rrggbb; the first ones don't change as n grows."""
    out = []
    for k in range(n):
        rgb = colorsys.hls_to_rgb((START + k * TURN) % 1, lightness if k % 2 == 0 else lightness - 0.14, saturation)
        out.append("#" + "".join(f"{round(255 * c):02x}" for c in rgb))
    return out


DEFAULT_COLORS = color_palette(8)


def _mixed(color: str, with_: int, amount: float) -> str:
    return "#" + "".join(f"{round(int(color[k : k + 2], 16) * (1 - amount) + with_ * amount):02x}" for k in (1, 3, 5))


def lighten(color: str, amount: float = 0.3) -> str:
    return _mixed(color, 255, amount)


def darken(color: str, amount: float = 0.3) -> str:
    return _mixed(color, 0, amount)


def create_color_map(labels: list[str], colors: list[str] | None = None) -> dict[str, str]:
    colors = colors or color_palette(len(labels))
    return {s: colors[k % len(colors)] for k, s in enumerate(labels)}
