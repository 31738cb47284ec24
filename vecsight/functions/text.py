"""String column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecsight.constants import RUN_NAME_PATTERN, UID_PATTERN


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def image_path(base: str, subject, study, dicom, ext: str = ".jpg") -> Column:
    """``base/p{first two of subject}/p{subject}/s{study}/{dicom}{ext}``."""
    subj = _c(subject).cast("string")
    return F.concat(F.lit(f"{base}/p"), F.substring(subj, 1, 2), F.lit("/p"), subj,
                    F.lit("/s"), _c(study).cast("string"), F.lit("/"), _c(dicom).cast("string"),
                    F.lit(ext))


def parent_name(path) -> Column:
    """Name of the folder that holds the file."""
    return F.element_at(F.split(_c(path), "/"), -2)


def base_name(path) -> Column:
    """File name."""
    return F.element_at(F.split(_c(path), "/"), -1)


def coerce_double(col) -> Column:
    """Text to double, anything unparsable or NaN becomes NULL."""
    v = _c(col).try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def uid_matches(name) -> Column:
    """I8: every uid match of the annotation-name pattern."""
    return F.regexp_extract_all(_c(name), F.lit(UID_PATTERN), 1)


WHITESPACE = " \t\n\x0b\f\r"   # the characters of the regex class \s


def strip(col) -> Column:
    """Python ``str.strip()`` (all leading and trailing whitespace, line breaks included),
    as a character-set trim (no regex)."""
    return F.btrim(_c(col), F.lit(WHITESPACE))


def words(col) -> Column:
    """Whitespace split, no empty pieces (Python ``str.split()``)."""
    t = strip(col)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


SENTENCE_PATTERN = r"[^.!?]+[.!?]*"


def sentences(col) -> Column:
    """I16 (re-aimed): sentence pieces by the regex ``[^.!?]+[.!?]*``, trimmed, blanks dropped."""
    pieces = F.regexp_extract_all(_c(col), F.lit(SENTENCE_PATTERN), 0)
    return F.filter(F.transform(pieces, lambda s: strip(s)), lambda s: s != "")


def run_name_parts(col) -> list[Column]:
    """``model_run_{i}_{flag}_{ig|igl}_{tg|tgl}`` -> (run, flag, image_loss, text_loss)."""
    c = _c(col)
    return [F.regexp_extract(c, RUN_NAME_PATTERN, 1).cast("int").alias("run"),
            (F.regexp_extract(c, RUN_NAME_PATTERN, 2) == "True").alias("flag"),
            F.regexp_extract(c, RUN_NAME_PATTERN, 3).alias("image_loss"),
            F.regexp_extract(c, RUN_NAME_PATTERN, 4).alias("text_loss")]


def fill_template(template, label) -> Column:
    """Replace ``{label}`` in a template."""
    return F.replace(_c(template), F.lit("{label}"), _c(label).cast("string"))
