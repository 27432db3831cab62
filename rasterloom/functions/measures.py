"""Scalar arithmetic of print geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mm_to_pixels(mm: Column, scale: Column) -> Column:
    return F.when(mm <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(mm / scale)).cast("int"))


def trimmed(value: Column, places: int = 6) -> Column:
    """Decimal text without trailing zeros, halves to even; minus zero is zero."""
    text = F.regexp_replace(F.format_string(f"%.{places}f", F.bround(value.cast("double"), places)), r"\.?0+$", "")
    return F.when(text.isin("-0", ""), F.lit("0")).otherwise(text)


def percent_change(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.when(after == 0, 0.0).otherwise(100.0)).otherwise(F.abs(after - before) / F.abs(before) * 100)


def slug(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(plain == "", F.lit("image")).otherwise(plain)


#: Thresholds in nozzle or line widths, areas in their squares.
FEATURE_WIDTHS, SEGMENT_WIDTHS, ISLAND_AREAS, GAP_WIDTHS, HOLE_SIDE_WIDTHS = 2, 3.75, 12.5, 1.5, 2.5


def printer_defaults(nozzle: Column, line: Column) -> dict[str, Column]:
    """Thresholds in mm that follow from nozzle and line width."""
    side = line * HOLE_SIDE_WIDTHS
    return {
        "min_feature_width_mm": F.greatest(nozzle, line) * FEATURE_WIDTHS,
        "min_segment_length_mm": line * SEGMENT_WIDTHS,
        "min_island_area_mm2": line * line * ISLAND_AREAS,
        "max_gap_mm": line * GAP_WIDTHS,
        "min_hole_area_mm2": side * side,
    }


def output_paths(root: str, stem: Column) -> dict[str, Column]:
    """Where a job's files go."""
    parts = {"cleaned": ("cleaned", "_cleaned.png"), "silhouette": ("masks", "_silhouette.png"), "svg": ("svg", ".svg"), "stl": ("stl", ".stl"), "model": ("3mf", ".3mf"), "mesh_report": ("reports", "_mesh_report.json"), "status": ("reports", "_status.json")}
    return {name: F.concat_ws("/", F.lit(root), stem, F.lit(folder), F.concat(stem, F.lit(end))) for name, (folder, end) in parts.items()}


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, dots standing for the rest."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def one_of(value: Column, allowed: list[str], default: str, name: str) -> Column:
    """A choice written by hand in its plain form; an error for what is not allowed."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit(default)))), "[ -]", "_")
    return F.when(plain.isin(*allowed), plain).otherwise(F.raise_error(F.concat(F.lit(f"{name} must be one of {sorted(allowed)}; got "), value)))


def at_least(value: Column, least: float, name: str, strictly: bool = False) -> Column:
    """A number not below ``least``, or above it; else an error."""
    fits = value > least if strictly else value >= least
    return F.when(fits, value).otherwise(F.raise_error(F.concat(F.lit(f"{name} is out of range: "), value.cast("string"))))


def backend_for(product: Column, wanted: Column) -> Column:
    """The mesh backend that a product asks for; lithophanes and filament reliefs have their own."""
    return F.when(product == "lithophane", "lithophane_heightfield").when(product == "filament_swap_relief", "filament_swap_heightmap").otherwise(wanted)
