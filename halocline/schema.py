"""Column layouts and the dictionary of observation types."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Observation type numbers of the file formats.
OBS_TYPES = {
    "u": 2819,
    "v": 2820,
    "t": 3073,
    "s": 5521,
    "ssh": 5526,
    "sst": 5525,
    "sss": 5522,
    "eta": 5351,
    "sic": 6282,
    "x": 1111,
    "y": 2222,
    "z": 3333,
    "hs": 2692,
    "hi": 8335,
    "t1": 8915,
    "t2": 8925,
    "cn": 8333,
    "ui": 8337,
    "vi": 8334,
    "sfcwnd": 100001,
}
#: Column of the variable-localisation matrix of each type.
LOCALISATION_COLUMN = {"u": 1, "v": 2, "t": 3, "s": 4, "ssh": 5, "sst": 6, "sss": 7, "eta": 8, "sfcwnd": 9}
SURFACE = ("ssh", "eta", "sst", "sss")
#: Constants of the formulas (pi is cut off in the file formats' own arithmetic).
PI, EARTH_RADIUS, GRAVITY, KELVIN, UNDEF = 3.1415926535, 6371300.0, 9.81, 273.15, -9.99e33
#: Limits of physical variables.
LIMITS = {"t": (-2.0, 40.0), "s": (0.0, 50.0), "u": (-99.0, 99.0), "v": (-99.0, 99.0), "h": (0.0, 90000.0), "eta": (-99.0, 99.0)}

_D, _I = T.DoubleType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


OBS1 = _struct(elem=_I, lon=_D, lat=_D, lev=_D, dat=_D, err=_D)
OBS2 = _struct(elem=_I, lon=_D, lat=_D, lev=_D, dat=_D, err=_D, ohx=_D, oqc=_I, obhr=_D)
OBS3 = _struct(elem=_I, lon=_D, lat=_D, lev=_D, dat=_D, err=_D, obhr=_D, platform=_D)
DRIFTER = _struct(elem=_I, x=_D, y=_D, z=_D, drifter=_I, err=_D, obhr=_D)
COUPLED = _struct(id=_I, lon=_D, lat=_D, lev=_D, dat=_D, err=_D, platform=_D, time=_D, ohx=_D, qc=_I)
#: An observation with H(x) of all members.
OBS_ENS = T.StructType([*OBS1.fields, T.StructField("obs_id", T.LongType()), T.StructField("slot", _I), T.StructField("hx", T.ArrayType(_D)), T.StructField("qc_members", T.ArrayType(_I))])
GRID = _struct(ij=T.LongType(), i=_I, j=_I, lon=_D, lat=_D, kmt=_I, wet=_D)
LEVELS = _struct(k=_I, lev=_D)
STATE = _struct(member=_I, ij=T.LongType(), k=_I, var=T.StringType(), value=_D)


@dataclass(frozen=True)
class FilterConfig:
    """Settings of the assimilation; the defaults are those of the documented namelists."""

    sigma_equator: float = 720_000.0
    sigma_pole: float = 200_000.0
    sigma_vertical: float = 1000.0
    vertical_localisation: bool = False
    metric: str = "chord"
    gross_error: float = 3.0
    qc_member_departure: bool = True
    qc_mean_departure: bool = True
    adaptive_error: bool = True
    most_latitude: float = 60.0
    least_sst: float = 5.0
    sss_range: tuple[float, float] = (29.0, 40.0)
    inflation: float = 1.0
    rtpp: float = 0.0
    rtps: float = 0.0
    additive: float = 0.0
    mixed_layer: bool = False
    block_basins: bool = False
    update_thickness: bool = True
    #: Weights of observation types (names of OBS_TYPES, 1 where it has none) for variables; variables with equal weights share a transform.
    variable_weights: dict[str, dict[str, float]] = field(default_factory=dict)
    physical_limits: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(LIMITS))

    def variable_groups(self) -> tuple[dict[str, int], list[dict[str, float]]]:
        """The group of each variable that has weights, and the weights of each group; all other variables are in group 0, whose weights are 1."""
        groups: list[dict[str, float]] = [{}]
        of = {}
        for var, weights in self.variable_weights.items():
            if unknown := set(weights) - set(OBS_TYPES):
                raise ValueError(f"no types of observations: {sorted(unknown)}")
            row = {name: float(w) for name, w in sorted(weights.items()) if w != 1.0}
            if row not in groups:
                groups.append(row)
            of[var] = groups.index(row)
        return of, groups
