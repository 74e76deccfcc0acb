"""Names, keys and values in text, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(text: Column, start: str, end: str) -> Column:
    """What stands between the first `start` and the next `end`; an error where either is missing (F1)."""
    found = F.regexp_extract(text, f"(?s){re.escape(start)}(.*?){re.escape(end)}", 1)
    has = F.regexp_like(text, F.lit(f"(?s){re.escape(start)}.*?{re.escape(end)}"))
    return F.when(text.isNull(), None).when(has, found).otherwise(F.raise_error(F.concat(F.lit(f"no value between {start} and {end} in "), text)).cast("string"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """A file's name up to its first dot (K1)."""
    return F.substring_index(base_name(path), ".", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def project_name(customer: Column, dataset: Column) -> Column:
    """F2, P6."""
    return F.replace(F.concat_ws("_", customer, dataset), F.lit("."), F.lit("_"))


def signature(width: Column, backbone: Column, mppx: Column, size: Column, height: Column, classes: Column, subset: Column) -> Column:
    """The name of a trained configuration."""
    return F.concat_ws("_", width.cast("string"), backbone, F.format_string("mppx%.2f", mppx), F.concat(F.lit("wh"), size.cast("string")), F.concat(F.lit("rgb"), F.when(height, "a").otherwise("")), F.concat(classes.cast("string"), F.lit("cls")), subset)


def box_key(*numbers: Column) -> Column:
    """F4."""
    return F.concat_ws("-", *(n.cast("string") for n in numbers))


def metric_title(name: Column) -> Column:
    """F6."""
    return F.when(name == "acc", "Accuracy").when(name == "loss", "Loss").otherwise(name)


def local_day(at: Column, zone: str) -> Column:
    """The date of an instant in a zone (F8)."""
    return F.date_format(F.from_utc_timestamp(at.cast("timestamp"), zone), "yyyy-MM-dd")
