"""Parameters, their validation, ink sets, papers and the preset text format."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace

SHAPES = ("lines", "wavy", "dots", "bluenoise", "hatch")
K_MODES = ("tonal", "contour")
#: Papers in millimetres.
PAPERS = {"A2": (420.0, 594.0), "A3": (297.0, 420.0), "A4": (210.0, 297.0), "A5": (148.0, 210.0)}
#: Default screen angles by ink set, in spray order.
DEFAULT_ANGLES = {"cmyk": {"c": 15.0, "m": 135.0, "y": 0.0, "k": 45.0}, "cmykog": {"c": 15.0, "m": 135.0, "y": 0.0, "o": 30.0, "g": 60.0, "k": 45.0}}
#: Name and the colour an ink multiplies white by.
INK_COLOURS = {"c": ("Cyan", (0.0, 1.0, 1.0)), "m": ("Magenta", (1.0, 0.0, 1.0)), "y": ("Yellow", (1.0, 1.0, 0.0)), "o": ("Orange", (1.0, 0.5, 0.0)), "g": ("Green", (0.0, 0.6, 0.2)), "k": ("Black", (0.0, 0.0, 0.0))}


@dataclass(frozen=True)
class Ink:
    channel: str
    name: str
    rgb: tuple[float, float, float]
    angle: float
    load: float = 1.0
    tamed: bool = False


def inks(kind: str = "cmyk", angles: dict[str, float] | None = None, loads: dict[str, float] | None = None) -> list[Ink]:
    """The inks of a set in spray order. Angles and loads go by channel; missing ones are the set's defaults and 1."""
    if kind not in DEFAULT_ANGLES:
        raise ValueError(f"unknown ink set {kind!r}")
    return [Ink(c, *INK_COLOURS[c], (angles or {}).get(c, a), (loads or {}).get(c, 1.0), c == "k") for c, a in DEFAULT_ANGLES[kind].items()]


def rotated(set_: list[Ink], delta: float) -> list[Ink]:
    """All inks turned together; angles stay in [0, 180)."""
    return [replace(i, angle=(i.angle + delta) % 180.0) for i in set_]


@dataclass(frozen=True)
class LineParams:
    spacing: float = 8.0
    w_min: float = 0.5
    min_material: float = 1.0
    kerf: float = 0.0
    bridge_interval: float = 0.0
    bridge_px: float = 0.0
    white: float = 0.0
    black: float = 1.0
    gamma: float = 1.0
    scurve: float = 0.0
    shape: str = "lines"
    k_mode: str = "tonal"
    k_deep_clip: float = 0.75
    k_gamma: float = 2.0
    k_width_frac: float = 0.40
    ucr: float = 0.8
    dog_small: float = 1.0
    dog_large: float = 2.0
    dog_threshold: float = 0.05
    auto_levels: bool = False
    wave_amp: float = 0.35
    wave_len: float = 4.0
    wave_width: float = 1.0
    hatch_bins: int = 6
    dot_min: float = math.inf
    dot_max: float = math.inf

    @property
    def max_cut(self) -> float:
        return max(self.spacing - self.min_material, 0.0)

    @property
    def v_step(self) -> float:
        return min(max(self.spacing / 2, 0.5), 4.0)

    def validate(self, set_: list[Ink] | None = None) -> LineParams:
        """Raises ValueError for what the command line rejects."""
        need = [
            (self.spacing > 0, "spacing must be over 0"), (self.min_material > 0, "min_material must be over 0"), (self.w_min > 0, "w_min must be over 0"),
            (self.auto_levels or 0 <= self.white < self.black <= 1, "levels must hold 0 <= white < black <= 1"), (self.gamma > 0, "gamma must be over 0"),
            (self.w_min < self.spacing - self.min_material, "w_min must be under spacing - min_material"), (self.kerf >= 0 and self.kerf < self.spacing, "kerf must be in [0, spacing)"),
            (self.bridge_interval >= 0 and self.bridge_px >= 0, "bridges must not be negative"), (self.scurve >= 0, "scurve must not be negative"),
            (0 <= self.k_deep_clip < 1, "k_deep_clip must be in [0, 1)"), (self.k_gamma > 0, "k_gamma must be over 0"), (0 < self.k_width_frac <= 1, "k_width_frac must be in (0, 1]"),
            (0 <= self.ucr <= 1, "ucr must be in [0, 1]"), (self.shape in SHAPES, f"shape must be one of {SHAPES}"), (self.k_mode in K_MODES, f"k_mode must be one of {K_MODES}"),
        ]
        need += [(0 < i.load <= 1, f"the load of {i.name} must be in (0, 1]") for i in set_ or []]
        for ok, why in need:
            if not ok:
                raise ValueError(why)
        return self

    def clamped(self) -> LineParams:
        """min_material and kerf inside [0, spacing - 0.01], as an interactive caller needs them."""
        most = self.spacing - 0.01
        return replace(self, min_material=min(max(self.min_material, 0.0), most), kerf=min(max(self.kerf, 0.0), most))


@dataclass(frozen=True)
class StencilParams:
    colors: int = 4
    bridge_px: float = 3.0
    min_feature_px: float = 9.0  # an area
    bridges: bool = True
    blur_px: float = 0.0
    white: float = 0.0
    black: float = 1.0
    gamma: float = 1.0
    smooth: float = 1.5

    def validate(self) -> StencilParams:
        if not 2 <= self.colors <= 256:
            raise ValueError("colors must be in 2..256")
        if self.bridges and self.bridge_px <= 0:
            raise ValueError("bridges need a width over 0")
        if not 0 <= self.white < self.black <= 1 or self.gamma <= 0:
            raise ValueError("levels must hold 0 <= white < black <= 1 and gamma > 0")
        return self


def paper(name: str) -> tuple[float, float]:
    """Width and height of a paper, whatever the case of its name."""
    if name.upper() not in PAPERS:
        raise ValueError(f"unknown paper {name!r}")
    return PAPERS[name.upper()]


def switched(kind: str) -> Preset:
    """What changing the ink set leaves: its own angles and loads."""
    return Preset(kind, angles=tuple(DEFAULT_ANGLES[kind].values()), loads=(1.0,) * len(DEFAULT_ANGLES[kind]))


@dataclass(frozen=True)
class Preset:
    """Every knob of both pipelines, as lines of ``key = value``; the knobs of the stencil begin with ``stencil.``"""

    kind: str = "cmyk"
    lines: LineParams = field(default_factory=LineParams)
    angles: tuple[float, ...] = tuple(DEFAULT_ANGLES["cmyk"].values())
    loads: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0)
    stencil: StencilParams = field(default_factory=StencilParams)
    mode: str = "halftone"
    paper: str | None = None
    margin: float = 10.0
    angles_locked: bool = False

    def dumps(self) -> str:
        rows = [("mode", self.mode), ("inks", self.kind), ("angles", " ".join(map(repr, self.angles))), ("loads", " ".join(map(repr, self.loads))), ("angles_locked", self.angles_locked), ("paper", self.paper or "none"), ("margin", self.margin)]
        rows += [(f.name, getattr(self.lines, f.name)) for f in fields(LineParams)]
        rows += [(f"stencil.{f.name}", getattr(self.stencil, f.name)) for f in fields(StencilParams)]
        return "# preset\n" + "".join(f"{k} = {v}\n" for k, v in rows)

    def loads_text(self, text: str) -> Preset:
        """This preset with what the text sets: unknown keys are skipped, bad values keep the old one, lists of a wrong length become the ink set's defaults."""
        got = {k.strip(): v.strip() for k, eq, v in (x.partition("=") for x in text.splitlines() if not x.lstrip().startswith("#")) if eq}

        def parsed(key: str, old):
            if key not in got:
                return old
            try:
                return {"true": True, "false": False}[got[key].lower()] if isinstance(old, bool) else type(old)(got[key])
            except (ValueError, KeyError):
                return old

        def knobs(old, start: str = ""):
            return replace(old, **{f.name: parsed(start + f.name, getattr(old, f.name)) for f in fields(old)})

        kind = got["inks"] if got.get("inks") in DEFAULT_ANGLES else self.kind
        lines = knobs(self.lines)
        lines = replace(lines, shape=lines.shape if lines.shape in SHAPES else self.lines.shape, k_mode=lines.k_mode if lines.k_mode in K_MODES else self.lines.k_mode)
        n = len(DEFAULT_ANGLES[kind])

        def numbers(key: str, old: tuple[float, ...], default: tuple[float, ...]) -> tuple[float, ...]:
            try:
                out = tuple(map(float, got[key].replace(",", " ").split())) if key in got else old
            except ValueError:
                out = old
            return out if len(out) == n else default

        mode = got["mode"] if got.get("mode") in ("halftone", "stencil") else self.mode
        sheet = got.get("paper", "").upper()
        sheet = None if sheet == "NONE" else sheet if sheet in PAPERS else self.paper
        angles, loads = numbers("angles", self.angles, tuple(DEFAULT_ANGLES[kind].values())), numbers("loads", self.loads, (1.0,) * n)
        return Preset(kind, lines, angles, loads, knobs(self.stencil, "stencil."), mode, sheet, parsed("margin", self.margin), parsed("angles_locked", self.angles_locked))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.dumps())

    @staticmethod
    def load(path: str) -> Preset:
        try:
            with open(path, encoding="utf-8") as f:
                return Preset().loads_text(f.read())
        except OSError as e:
            raise ValueError(f"can't read the preset: {e}") from None

    def inks(self) -> list[Ink]:
        names = list(DEFAULT_ANGLES[self.kind])
        return inks(self.kind, dict(zip(names, self.angles)), dict(zip(names, self.loads)))
