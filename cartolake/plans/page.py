"""Pages: sizes, elements and the parts around a map, as plain metadata."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: Page sizes in millimetres, upright.
PAGES = {"A0": (841, 1189), "A1": (594, 841), "A2": (420, 594), "A3": (297, 420), "A4": (210, 297), "Letter": (215.9, 279.4), "Tabloid": (279.4, 431.8)}


@dataclass
class Page:
    size: str = "A4"
    landscape: bool = False
    dpi: float = 300.0
    margin_mm: float = 10.0
    elements: list[dict[str, Any]] = field(default_factory=list)

    @property
    def millimetres(self) -> tuple[float, float]:
        w, h = PAGES[self.size]
        return (h, w) if self.landscape else (w, h)

    @property
    def pixels(self) -> tuple[int, int]:
        w, h = self.millimetres
        return int(w / 25.4 * self.dpi), int(h / 25.4 * self.dpi)

    @property
    def map_pixels(self) -> tuple[int, int]:
        w, h = (x - 2 * self.margin_mm for x in self.millimetres)
        return int(w / 25.4 * self.dpi), int(h / 25.4 * self.dpi)

    @property
    def scale_factor(self) -> float:
        return self.dpi / 96.0

    @property
    def view_box(self) -> str:
        w, h = self.millimetres
        return f"0 0 {w:g} {h:g}"

    def add(self, kind: str, element_id: str, **settings: Any) -> Page:
        if kind not in ("map", "title", "legend", "scale-bar", "north-arrow", "text", "image", "graticule"):
            raise ValueError(f"unknown element {kind}")
        self.elements.append({"kind": kind, "id": element_id, **settings})
        return self

    def element(self, element_id: str) -> dict[str, Any] | None:
        return next((e for e in self.elements if e["id"] == element_id), None)
