"""Strings, numbers, boxes and nested values as Columns; nulls stay null unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "ae"), ("Ö", "oe"), ("Ü", "ue"), ("ß", "ss"))
TRUE_WORDS, FALSE_WORDS = ("true", "t", "1", "yes", "y"), ("false", "f", "0", "no", "n")


def class_key(c: Column) -> Column:
    """A name as a column key: umlauts written out, lower case, runs of anything else to one underscore."""
    for a, b in UMLAUTS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.btrim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", "_"), F.lit("_"))


def file_key(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9A-Za-z_]+", "_")


def base_name(c: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).cast("int")


def year_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(20\d{2})", 1), F.lit("")).cast("int")


def tile_id(c: Column) -> Column:
    """``dddd-dddd`` from ``dddd[-_ ]dddd`` or eight digits, else null."""
    digits = F.translate(c, "-_ ", "")
    fits = c.rlike(r"^\d{4}[-_ ]\d{4}$") | c.rlike(r"^\d{8}$")
    return F.when(fits, F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 4)))


def clip(c: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null and NaN stay as they are."""
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(default))


def number_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def boolish(c: Column) -> Column:
    """True and false words as booleans, anything else null."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*FALSE_WORDS), F.lit(False))


def keep_or_null(c: Column, values) -> Column:
    return c.isin(*values) | c.isNull()


def not_in_or_null(c: Column, values) -> Column:
    """Exclusion under which nulls survive."""
    return ~F.coalesce(c.isin(*values), F.lit(False))


def first_of(c: Column) -> Column:
    """First element of a list, null if there is none."""
    return F.try_element_at(c, F.lit(1))


def box_clamp(b: dict[str, Column], width, height) -> dict[str, Column]:
    """Box corners as whole pixels within the image."""
    def into(c, most):
        return F.when(c.isNotNull(), F.greatest(F.lit(0), F.least(c.cast("int"), most if isinstance(most, Column) else F.lit(most))))

    return {"x1": into(b["x1"], width), "y1": into(b["y1"], height), "x2": into(b["x2"], width), "y2": into(b["y2"], height)}


def from_centre(cx: Column, cy: Column, w: Column, h: Column, width, height) -> dict[str, Column]:
    """Normalised centre and size to pixel corners."""
    return {"x1": (cx - w / 2) * width, "y1": (cy - h / 2) * height, "x2": (cx + w / 2) * width, "y2": (cy + h / 2) * height}


def to_centre(x1: Column, y1: Column, x2: Column, y2: Column, width, height) -> dict[str, Column]:
    return {"cx": (x1 + x2) / 2 / width, "cy": (y1 + y2) / 2 / height, "w": (x2 - x1) / width, "h": (y2 - y1) / height}


def geometry_json(c: Column) -> Column:
    """A geometry from JSON or a literal with single quotes; null if neither."""
    return F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "type string, coordinates array<double>")


def numbers_json(c: Column) -> Column:
    """A list of numbers from its text, null if it isn't one."""
    return F.from_json(c, "array<double>")


def argmax_label(p: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(p, F.array_max(p)).cast("int"))


def bounds(coordinates: Column) -> Column:
    """Least and greatest of a list of [x, y] as a struct."""
    x, y = F.transform(coordinates, lambda p: p[0]), F.transform(coordinates, lambda p: p[1])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def flat_normalised(polygon: Column, width, height) -> Column:
    """A list of [x, y] as one list of numbers in shares of the image's size."""
    return F.flatten(F.transform(polygon, lambda p: F.array(p[0] / width, p[1] / height)))


def normalised_probabilities(columns: list[Column]) -> Column:
    """Probabilities that sum to 1; nulls count as 0, and all stay 0 where the sum is."""
    clean = [F.coalesce(c, F.lit(0.0)) for c in columns]
    total = sum(clean[1:], clean[0])
    return F.array(*[c / F.when(total == 0, 1.0).otherwise(total) for c in clean])


def rescaled(b: dict[str, Column], from_width, from_height, to_width, to_height) -> dict[str, Column]:
    """Box corners in an image of another size, as whole pixels towards zero."""
    return {n: (b[n] * ((to_width if n[0] == "x" else to_height) / (from_width if n[0] == "x" else from_height))).cast("int") for n in ("x1", "y1", "x2", "y2")}


def container_json(c: Column) -> Column:
    """A list, map or struct as JSON text."""
    return F.to_json(c)


def run_tag(at: Column | None = None) -> Column:
    """A time, now by default, as a tag for names of runs."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss")
