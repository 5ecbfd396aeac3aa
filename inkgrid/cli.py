"""halftone and stencil over image files: ``python -m inkgrid.cli halftone|stencil --input PATH --out-prefix FOLDER/NAME [--flag value]...``

Halftone needs --spacing-px, --min-material-px and --min-cut-px, stencil --colors. --preset FILE sets what no flag sets. One
image gives NAME_c.svg and so on, several put each image's own name in between; the folder must be one that all executors share.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .params import DEFAULT_ANGLES, Ink, LineParams, Preset, StencilParams, inks, paper
from .plans import pipelines
from .sources import rasters, sinks

#: Flags that are numbers, and the field each sets.
HALFTONE = {
    "spacing-px": "spacing", "min-material-px": "min_material", "min-cut-px": "w_min", "kerf-px": "kerf", "bridge-interval-px": "bridge_interval", "bridge-px": "bridge_px", "white-point": "white", "black-point": "black", "gamma": "gamma",
    "scurve": "scurve", "k-deep-clip": "k_deep_clip", "k-gamma": "k_gamma", "k-width-frac": "k_width_frac", "ucr": "ucr", "dog-sigma1": "dog_small", "dog-sigma2": "dog_large", "dog-threshold": "dog_threshold",
    "wave-amp-frac": "wave_amp", "wave-len-frac": "wave_len", "wave-width-frac": "wave_width", "hatch-bins": "hatch_bins", "dot-min-px": "dot_min", "dot-max-px": "dot_max",
}
STENCIL = {"smooth-px": "smooth", "coarsen-px": "blur_px", "white-point": "white", "black-point": "black", "gamma": "gamma"}
NEEDED = {"halftone": ("spacing-px", "min-material-px", "min-cut-px"), "stencil": ("colors",)}
ON = ("on", "true", "1")


def flags(argv: list[str]) -> dict[str, str]:
    """--flag value pairs; unknown flags are kept and ignored."""
    return {a[2:]: b for a, b in zip(argv[::2], argv[1::2]) if a.startswith("--")}


def number(given: dict[str, str], flag: str, kind: Callable = float):
    try:
        return kind(given[flag])
    except ValueError:
        raise ValueError(f"--{flag} must be {'an integer' if kind is int else 'a number'}") from None


def numbers(params, given: dict[str, str], table: dict[str, str], needed: tuple[str, ...] = ()):
    """Needed flags must parse; others that don't leave the field as it is."""
    for flag, name in table.items():
        if flag in given:
            try:
                params = replace(params, **{name: number(given, flag, type(getattr(params, name)))})
            except ValueError:
                if flag in needed:
                    raise
    return params


def per_ink(given: dict[str, str], flag: str, n: int) -> list[float] | None:
    if flag not in given:
        return None
    try:
        out = [float(x) for x in given[flag].split(",")]
    except ValueError:
        raise ValueError(f"--{flag} must be comma-separated numbers") from None
    if len(out) != n:
        raise ValueError(f"--{flag} needs {n} values for these inks (got {len(out)})")
    return out


def ink_set(given: dict[str, str], preset: Preset) -> list[Ink]:
    kind = given.get("inks", preset.kind)
    kind = kind if kind in DEFAULT_ANGLES else "cmyk"
    base = preset.inks() if kind == preset.kind else inks(kind)
    names = [i.channel for i in base]
    angles, loads = per_ink(given, "angles", len(names)), per_ink(given, "loads", len(names))
    if angles is None:  # single angles, for the four usual inks
        angles = [number(given, f"angle-{i.channel}") if f"angle-{i.channel}" in given and i.channel in "cmyk" else i.angle for i in base]
    return inks(kind, dict(zip(names, angles)), dict(zip(names, loads or [i.load for i in base])))


def line_params(given: dict[str, str], base: LineParams) -> LineParams:
    p = numbers(base, given, HALFTONE, NEEDED["halftone"])
    if "shape" in given:
        shape = {"blue-noise": "bluenoise"}.get(given["shape"], given["shape"])
        p = replace(p, shape=shape if shape in ("wavy", "dots", "bluenoise", "hatch") else "lines")
    if "k-mode" in given:
        p = replace(p, k_mode="contour" if given["k-mode"] == "contour" else "tonal")
    return replace(p, auto_levels=given["auto-levels"] == "on") if "auto-levels" in given else p


def stencil_params(given: dict[str, str], base: StencilParams) -> StencilParams:
    """Bridges are off unless asked for; then they need a least width, which is theirs too if none is given."""
    p = numbers(base, given, STENCIL)
    if "colors" in given:
        p = replace(p, colors=number(given, "colors", int))
    if "min-feature-px" in given:
        try:
            p = replace(p, min_feature_px=float(given["min-feature-px"]) ** 2)  # a side; the field is an area
        except ValueError:
            pass
    if "bridges" in given or "preset" not in given:
        p = replace(p, bridges=given.get("bridges") in ON)
    if p.bridges and "bridges" in given:
        if "min-material-px" not in given:
            raise ValueError("--bridges on requires --min-material-px")
        least = number(given, "min-material-px")
        if least <= 0:
            raise ValueError("--min-material-px must be > 0")
        try:
            own = float(given.get("bridge-px", 0))
        except ValueError:
            own = 0.0
        p = replace(p, bridge_px=own if own > 0 else least)
    return p


def say(rows: DataFrame, line: Callable, most: int = 200) -> None:
    """Lines about the first sheets; all of them are in the report beside the files."""
    for r in rows.limit(most).collect():
        print(line(r), file=sys.stderr)


def run(spark: SparkSession, kind: str, given: dict[str, str]) -> None:
    preset = Preset.load(given["preset"]) if "preset" in given else Preset()
    missing = [f for f in ("input", *(() if "preset" in given else NEEDED[kind])) if f not in given]
    if missing:
        raise ValueError(f"missing required --{missing[0]}")
    folder, prefix = os.path.split(given.get("out-prefix", "out"))
    folder = folder or "."
    px = rasters.images(spark, given["input"])
    many = rasters.image_sizes(spark, given["input"]).limit(2).count() > 1
    write = lambda df, part, ending, value, suffix: sinks.write_local(sinks.named(df, prefix, many, part, ending), folder, "name", value, suffix)
    if kind == "halftone":
        set_, sheet = ink_set(given, preset), given.get("paper", preset.paper)
        if sheet is not None:
            paper(sheet)
        try:
            margin = float(given.get("margin-mm", preset.margin))
        except ValueError:
            margin = preset.margin
        got = pipelines.halftone(px, line_params(given, preset.lines).validate(set_), set_, sheet, margin)
        write(got.sheets, F.col("channel"), "", "svg", "svg")
        write(sinks.preview_pngs(got.preview), None, "preview", "png", "png")
        sinks.write_table(got.stiffness, os.path.join(folder, f"{prefix}_report"))
        say(got.stiffness.orderBy("image_id", "channel"), lambda r: f"{r['image_id']} layer {r['channel']}: {r['n_ribbons']} ribbons, cut {100 * r['removed']:.0f}%, neck {r['neck_px']:.1f}px{'  <- fragile' if r['neck_px'] < 1 else ''}")
        return
    form = given.get("format", "svg")
    if form not in ("svg", "png"):
        raise ValueError(f"--format must be svg or png (got {form})")
    got = pipelines.stencil(px.select("image_id", "x", "y", *(F.round(F.col(c) * 255).cast("int").alias(c) for c in "rgb")), stencil_params(given, preset.stencil).validate())
    layer = F.col("layer").cast("string")
    write(got.sheets if form == "svg" else sinks.stencil_pngs(got.masks.select("image_id", "layer", "x", "y", "keep"), got.palette), layer, "", form, form)
    write(sinks.palette_files(got.palette), None, "palette", "text", "txt")
    sinks.write_table(got.report, os.path.join(folder, f"{prefix}_report"))
    say(got.report.orderBy("image_id", "layer"), lambda r: f"{r['image_id']} layer {r['layer']}: {r['n_kept']} px kept, {r['n_outers']} outers, {r['n_holes']} holes")


def main(argv: list[str]) -> int:
    kind, rest = ("halftone", argv) if not argv or argv[0].startswith("--") else (argv[0], argv[1:])
    if kind not in NEEDED or not rest:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        run(SparkSession.builder.getOrCreate(), kind, flags(rest))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
