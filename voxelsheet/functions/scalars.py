"""Intensity, score, name and path expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UINT16_MAX = 65535
UINT8_MAX = 255


def unit_from_uint16(v: Column) -> Column:
    return v / F.lit(float(UINT16_MAX))


def unit_from_uint8(v: Column) -> Column:
    return v / F.lit(float(UINT8_MAX))


def centered(v: Column) -> Column:
    """[0, 1] to [-1, 1]."""
    return (v - 0.5) / 0.5


def high_byte(v: Column) -> Column:
    return F.shiftright(v, 8)


def clip(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def grey(r: Column, g: Column, b: Column) -> Column:
    """8-bit luma with fixed-point weights 19595, 38470, 7471 over 65536, rounded."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def rewindow(v: Column, in_min, in_max, out_min, out_max) -> Column:
    """Linear map of the input window to the output window, clipped to it."""
    mapped = (v - in_min) / (in_max - in_min) * (out_max - out_min) + out_min
    return F.least(F.greatest(mapped, F.lit(out_min)), F.lit(out_max))


def ink_pixel(p1: Column) -> Column:
    """Class probability to 16-bit intensity; not clipped."""
    return (p1 * UINT16_MAX).cast("int")


def rgb_pixel(v: Column) -> Column:
    return clip(v * UINT8_MAX, 0.0, 255.0).cast("int")


def texture_pixel(v: Column) -> Column:
    return clip(v * UINT16_MAX, 0.0, 65535.0).cast("int")


def pixel_scores(p255: Column) -> tuple[Column, Column]:
    """(no ink, ink) scores of an 8-bit prediction pixel."""
    ink = unit_from_uint8(p255)
    return F.lit(1.0) - ink, ink


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    powers = [F.exp(s - top) for s in scores]
    total = powers[0]
    for p in powers[1:]:
        total = total + p
    return [p / total for p in powers]


def f_score(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    bottom = precision * b2 + recall
    return F.when(bottom == 0, 0.0).otherwise(
        (1 + b2) * (precision * recall) / F.when(bottom == 0, 1.0).otherwise(bottom)
    )


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (F.bit_count(n) == 1)


def zero_padded(n: Column, digits) -> Column:
    """Left-pad with zeros; numbers that are longer stay whole."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.length(text), digits if isinstance(digits, Column) else F.lit(digits)), "0")


def ramp(position: Column, width: int) -> Column:
    return (position / float(width) * 255).cast("int")


def flat_index(z: Column, y: Column, x: Column, height, width) -> Column:
    return (z * height + y) * width + x


def int_div(a: Column, b) -> Column:
    """Whole-number division of non-negative integers."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b)).cast("int")


def unflatten(index: Column, height, width) -> tuple[Column, Column, Column]:
    """(z, y, x) of a flat block index."""
    return int_div(index, height * width), int_div(index, width) % height, index % width


def conv_output_size(size: Column, kernel: Column, stride: Column, padding: Column, dilation: Column) -> Column:
    return F.floor((size + padding * 2 - dilation * (kernel - 1) - 1) / stride + 1)


# --- names and paths ---------------------------------------------------------

# Fixed patterns of run folders and prediction files.
RUN_STAMP = r"\d\d\d\d-\d\d-\d\d_\d\d\.\d\d\.\d\d"
RUN_FOLDER = RUN_STAMP + r"$"
FOLD_FOLDER = RUN_STAMP + r"_(\d+)$"
PREDICTION_FILE = r"^(.*)_prediction_(final|\d+_\d+)_(.*)\.png$"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_fold_folder(name: Column) -> Column:
    return name.rlike(FOLD_FOLDER)


def is_job_folder(name: Column) -> Column:
    return is_fold_folder(name) | name.rlike(RUN_FOLDER)


def fold_number(name: Column) -> Column:
    """Fold of a k-fold folder, -1 for any other."""
    text = F.regexp_extract(name, FOLD_FOLDER, 1)
    return F.when(text == "", -1).otherwise(F.when(text == "", "0").otherwise(text).cast("int"))


def prediction_file_part(name: Column, group: int) -> Column:
    """1 region, 2 iteration, 3 label type; null when the name does not fit."""
    return F.nullif(F.regexp_extract(name, PREDICTION_FILE, group), F.lit(""))


def iteration_key(iteration: Column) -> Column:
    """Sort key: epoch first, batch second, ``final`` after everything."""
    parts = F.split(F.when(iteration == "final", "0_0").otherwise(iteration), "_")
    number = parts[0].cast("bigint") * 10_000_000_000 + parts[1].cast("bigint")
    return F.when(iteration == "final", F.lit(9_223_372_036_854_775_807)).otherwise(number)


def label_column(label_type: Column) -> Column:
    """Label key of a prediction type; an unknown type is an error."""
    known = F.when(label_type == "ink_classes", "ink_label").when(label_type == "rgb_values", "rgb_label")
    known = known.when(label_type == "volcart_texture", "volcart_texture_label")
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown prediction type "), label_type)).cast("string"))


LABEL_TYPES = ("ink_classes", "rgb_values", "volcart_texture")


def label_types(outputs: Column) -> Column:
    """Those outputs of a model that have labels, in a fixed order."""
    return F.array_intersect(F.array(*[F.lit(x) for x in LABEL_TYPES]), outputs)


def is_absolute(path: Column) -> Column:
    return path.startswith("/") | path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def _collapse(path: Column) -> Column:
    """Fold '.', '' and '..' segments of an absolute path."""
    start = F.array().cast("array<string>")

    def step(done, part):
        return (
            F.when((part == "") | (part == "."), done)
            .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), start, step), "/"))


def resolve_path(path: Column, base_folder: Column) -> Column:
    """Relative paths are taken from the descriptor's folder, others kept."""
    return F.when(is_absolute(path), path).otherwise(_collapse(F.concat_ws("/", base_folder, path)))


def relocate_path(path: Column, prefix: str, root: str) -> Column:
    """Replace a known storage prefix by a local root, for paths that hold it."""
    return F.when(path.contains(prefix), F.concat(F.lit(root.rstrip("/") + "/"), F.replace(path, F.lit(prefix), F.lit(""))))
