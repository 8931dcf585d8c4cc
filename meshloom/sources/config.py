"""Case files and engine settings."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame

from meshloom.operators.boundary import Inflow

#: Names of inflow types and their numbers; other types are given as numbers.
INFLOW_TYPES = {"rotatedparabola1": 1, "rotatedparabola2": 2, "flat": 3, "curvedflat": 4, "rectangle": 5, "curvedrectangle": 6}
INFLOW_SECTION = "e3dprocessparameters/inflow_"


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds of all stages, with the values that are shipped."""

    # names as in settings files
    cylinder_boundary_tolerance_factor: float = 0.90
    box_boundary_tolerance_factor: float = 0.50
    tolerance_floor: float = 1e-12
    neighbor_diameter_ratio_flag: float = 2.0
    neighbor_normal_angle_limit_deg: float = 60.0
    small_angle_limit_deg: float = 0.50
    relative_min_search_radius: float = 0.005
    dihedral_angle_threshold_rad: float = 0.3
    face_aspect_ratio_limit: float = 10.0
    edge_ratio_limit: float = 10.0
    min_diameter_fraction: float = 1e-4
    gap_score_threshold: float = 0.95
    score_percentile_fallback: float = 0.10
    monitor_histogram_base: float = 3.0
    monitor_histogram_eps: float = 1e-12
    histogram_target_fraction: float = 1e-4
    histogram_min_fraction_threshold: float = 1e-3
    histogram_min_fraction_connected_threshold: float = 1e-4
    histogram_max_fraction_threshold: float = 0.66
    max_histogram_span_bins: int = 3
    min_histogram_span_bins: int = 1
    coarse_mesh_scaling: float = 1.5
    monitor_threshold_default: float = 1.25
    deformation_steps: int = 4
    characteristic_scale: float = 100.0
    monitor_zero_bin_threshold_percent: float = 1.0


def engine_config(path: str | None = None) -> EngineConfig:
    """The settings of a file, or of the one that PREPROCESSOR_CONFIG names; values that can't be read keep their defaults."""
    path, out = path or os.environ.get("PREPROCESSOR_CONFIG"), EngineConfig()
    if not path or not os.path.exists(path):
        return out
    parser = configparser.ConfigParser(inline_comment_prefixes=("#", ";"), strict=False, interpolation=None)
    parser.read(path)
    found = {k: v for section in parser.sections() for k, v in parser[section].items()}
    for f in fields(out):
        try:
            out = replace(out, **{f.name: type(getattr(out, f.name))(float(found[f.name]))})
        except (KeyError, ValueError):
            continue
    return out


@dataclass(frozen=True)
class MeshConfig:
    """A case's geometry; what the file doesn't give is None."""

    mesh_type: str | None = None
    geometry_start: tuple[float, ...] | None = None
    geometry_length: tuple[float, ...] | None = None
    barrel_diameter: float | None = None
    inner_diameter: float | None = None
    barrel_length: float | None = None
    axial_start: float | None = None
    min_gap: float | None = None
    extra: dict[str, str] = field(default_factory=dict)


def vector(text: str | None) -> tuple[float, ...] | None:
    try:
        return tuple(float(x) for x in (text or "").strip("[]() ").split(",")) if text else None
    except ValueError:
        return None


def number(text: str | None) -> float | None:
    try:
        return float(text) if text else None
    except ValueError:
        return None


def mesh_config(settings: DataFrame) -> MeshConfig:
    """The geometry in a case's settings (section, key, value); the last value of a key counts."""
    found = {r["key"]: r["value"] for r in settings.orderBy("n").collect()}  # a settings file
    return MeshConfig(
        mesh_type=found.get("hexmesher"),
        geometry_start=vector(found.get("geometrystart")),
        geometry_length=vector(found.get("geometrylength")),
        barrel_diameter=number(found.get("barreldiameter")),
        inner_diameter=number(found.get("innerdiameter")),
        barrel_length=number(found.get("barrellength")),
        axial_start=number(found.get("axialstart")),
        min_gap=number(found.get("mingap")),
        extra=found,
    )


def inflows(settings: DataFrame) -> list[Inflow]:
    """The inflows of a case, in the order of their sections' numbers."""
    by: dict[int, dict[str, str]] = {}
    for r in settings.orderBy("n").collect():
        tail = (r["section"] or "").removeprefix(INFLOW_SECTION)
        if tail != r["section"] and tail.isdigit():
            by.setdefault(int(tail), {})[r["key"]] = r["value"]
    out = []
    for _, v in sorted(by.items()):
        kind = v.get("type", "").lower()
        out.append(
            Inflow(
                INFLOW_TYPES.get(kind) or int(number(kind) or 0),
                vector(v.get("normal")),
                vector(v.get("center")),
                number(v.get("outerradius")),
                number(v.get("innerradius")),
                vector(v.get("midpointa")),
                vector(v.get("midpointb")),
            )
        )
    return out
