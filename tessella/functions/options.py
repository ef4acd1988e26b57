"""The options of a written raster: names, defaults, what is refused, and how layers of them combine."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import HALO

# Option names and defaults.
DEFAULTS: dict[str, Any] = {"sparse_ok": True, "geotiff_version": 1.1, "blocksize": 512, "cog_ghost_data": False, "statistics": False, "compress": "deflate"}
# Names that are refused because they would move, re-cut or re-order pixels.
REFUSED = ("warp_resampling", "target_srs", "tiling_scheme", "interleave", "jpegtablesmode", "blockxsize", "blockysize", "zoom_level", "zoom_level_strategy", "res", "extent", "aligned_levels", "add_alpha")
# Names whose values are always these.
REQUIRED: dict[str, Any] = {"driver": "cog", "bigtiff": "yes", "tiled": "yes", "overviews": "auto", "sharing": False}
CODECS = ("none", "deflate", "zstd", "lzma", "lzw")
ABSENT_CODECS = ("jpeg", "webp", "lerc", "lerc_deflate", "lerc_zstd", "jxl")
#: Options whose string values don't depend on case.
CASELESS = ("overview_resampling", "resampling", "compress", "overview_compress", "predictor", "overview_predictor", "driver", "bigtiff")
PREDICTORS = {"no": 1, "standard": 2, "yes": 2, "floating_point": 3, "1": 1, "2": 2, "3": 3}


class OptionError(ValueError):
    """An option that can't be met."""


#: Words for a switch that is on, and for one that is off.
ON, OFF = ("yes", "true", "on", "1"), ("no", "false", "off", "0")


def switch(name: str, value: Any) -> bool:
    """Whether a switch is on: a boolean, a number, or a word for one in any case."""
    if not isinstance(value, str):
        return bool(value)
    word = value.strip().lower()
    if word not in ON + OFF:
        raise OptionError(f"{name} must be one of {', '.join(ON + OFF)}")
    return word in ON


def lowered(options: Mapping[str, Any]) -> dict[str, Any]:
    """Keys in lower case; values too where they are names."""
    out = {}
    for key, value in options.items():
        name = key.lower()
        out[name] = value.lower() if isinstance(value, str) and name in CASELESS else value
    return out


def overlaid(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """All layers in one; of equal keys the last one's value holds."""
    out: dict[str, Any] = {}
    for layer in layers:
        out.update(layer)
    return out


def checked(options: Mapping[str, Any]) -> dict[str, Any]:
    """The user's options in normal form, or an OptionError that says what is wrong."""
    out = lowered(options)
    wrong = [name for name in (*REFUSED, *REQUIRED) if name in out]
    if wrong:
        raise OptionError(f"options that are not supported: {', '.join(wrong)}")
    if "overview_resampling" not in out and "resampling" in out:
        out["overview_resampling"] = out.pop("resampling")
    if out.get("overview_resampling") not in HALO:
        raise OptionError(f"overview_resampling must be one of {', '.join(HALO)}")
    if int(out.get("blocksize", DEFAULTS["blocksize"])) % 16 or int(out.get("blocksize", DEFAULTS["blocksize"])) < 16:
        raise OptionError("blocksize must be a multiple of 16")
    for name in ("compress", "overview_compress"):
        codec = out.get(name, "none")
        if codec in ABSENT_CODECS:
            raise OptionError(f"{name}: there is no {codec} codec in this environment")
        if codec not in CODECS:
            raise OptionError(f"{name} must be one of {', '.join(CODECS)}")
    for name in ("predictor", "overview_predictor"):
        if str(out.get(name, "no")).lower() not in PREDICTORS:
            raise OptionError(f"{name} must be one of {', '.join(PREDICTORS)}")
    return out


def for_overviews(profile: Mapping[str, Any]) -> dict[str, Any]:
    """The profile of overviews: their own codec, quality and predictor in place of the image's.  Another
    codec doesn't take over the image's quality and predictor."""
    out = dict(profile)
    if "overview_compress" in out and out["overview_compress"] != out.get("compress"):
        out.pop("quality", None)
        out.pop("predictor", None)
    for name in ("compress", "quality", "predictor"):
        if f"overview_{name}" in out:
            out[name] = out[f"overview_{name}"]
    return out


@dataclass(frozen=True)
class CogOptions:
    """The options of one raster, checked and complete."""

    kernel: str
    blocksize: int = 512
    overview_count: int | None = None
    compress: str = "deflate"
    predictor: int = 1
    overview_compress: str = "deflate"
    overview_predictor: int = 1
    level: int | None = None
    overview_level: int | None = None
    sparse_ok: bool = True
    geotiff_version: float = 1.1
    ghost: bool = True
    statistics: bool = False
    nodata: float | None = None
    crs: str | None = None
    transform: tuple[float, ...] | None = None
    bigtiff: bool = True
    #: tags, descriptions, offsets, scales, units, colorinterp, colormap, gcps, rpcs
    meta: dict[str, Any] = field(default_factory=dict)
    #: Options without a meaning here.
    extra: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, user: Mapping[str, Any], source: Mapping[str, Any] | None = None) -> CogOptions:
        """From the user's options and what the source knows of itself (transform, crs, nodata); the user's win.

        Tiles are always written row by row, which is what leaders and trailers of blocks need, so
        they are on unless the user turns them off.
        """
        own = checked(user)
        p = overlaid(DEFAULTS, source or {}, own)
        over = for_overviews(p)
        meta_names = ("update_tags", "descriptions", "offsets", "scales", "units", "colorinterp", "write_colormap", "gcps", "rpcs")
        used = {*DEFAULTS, *meta_names, "overview_resampling", "overview_count", "quality", "predictor", "overview_compress", "overview_quality", "overview_predictor", "level", "overview_level", "nodata", "crs", "transform"}
        quality = lambda q: None if q.get("quality") is None else int(q["quality"])
        return cls(
            kernel=p["overview_resampling"],
            blocksize=int(p["blocksize"]),
            overview_count=None if p.get("overview_count") is None else int(p["overview_count"]),
            compress=p["compress"],
            predictor=PREDICTORS[str(p.get("predictor", "no")).lower()],
            overview_compress=over["compress"],
            overview_predictor=PREDICTORS[str(over.get("predictor", "no")).lower()],
            level=p.get("level", quality(p)),
            overview_level=p.get("overview_level", quality(over)),
            sparse_ok=switch("sparse_ok", p["sparse_ok"]),
            geotiff_version=float(p["geotiff_version"]),
            ghost=switch("cog_ghost_data", own.get("cog_ghost_data", True)),
            statistics=switch("statistics", p["statistics"]),
            nodata=p.get("nodata"),
            crs=None if p.get("crs") is None else str(p["crs"]),
            transform=None if p.get("transform") is None else tuple(map(float, tuple(p["transform"])[:6])),
            meta={k: p[k] for k in meta_names if p.get(k) is not None},
            extra={k: v for k, v in p.items() if k not in used},
        )


# Many jobs at once, as rows (job, layer, key, value).


def overlay_rows(rows: DataFrame) -> DataFrame:
    """job, key and value of each job's options after overlaying its layers; keys in lower case."""
    named = rows.withColumn("key", F.lower("key"))
    value = F.when(F.col("key").isin(*CASELESS), F.lower("value")).otherwise(F.col("value"))
    return named.withColumn("value", value).groupBy("job", "key").agg(F.max_by("value", "layer").alias("value"))


def refused_rows(rows: DataFrame) -> DataFrame:
    """job, n_refused and resampling_ok of each job: how many of its keys are refused, and whether it names a kernel."""
    key = F.lower("key")
    kernel: Column = F.coalesce(F.max(F.when(key == "overview_resampling", F.lower("value"))), F.max(F.when(key == "resampling", F.lower("value"))))
    refused = key.isin(*REFUSED, *REQUIRED)
    out = rows.groupBy("job").agg(F.count_distinct(F.when(refused, key)).alias("n_refused"), kernel.alias("kernel"))
    return out.select("job", "n_refused", F.coalesce(F.col("kernel").isin(*HALO), F.lit(False)).alias("resampling_ok"))


def overview_rows(options: DataFrame) -> DataFrame:
    """job, compress, quality and predictor of each job's overviews.  options: overlaid rows (job, key, value)."""
    names = ("compress", "quality", "predictor")
    wide = options.groupBy("job").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for n in names for k in (n, f"overview_{n}")))
    other = F.col("overview_compress").isNotNull() & ~F.col("overview_compress").eqNullSafe(F.col("compress"))
    return wide.select("job", F.coalesce("overview_compress", "compress").alias("compress"), *(F.coalesce(F.col(f"overview_{n}"), F.when(~other, F.col(n))).alias(n) for n in ("quality", "predictor")))
