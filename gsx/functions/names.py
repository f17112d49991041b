"""Expressions over column names, paths and run names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name classes, first match wins (case-insensitive, anchored).
NAME_CLASSES = (
    ("Voice Quality", ("jitter", "shimmer", "HNR", "logHNR", "voicingProb", "F0final", "F0env")),
    ("MFCC", ("mfcc",)),
    ("Prosodic/Energy", ("pcm_loudness", "pcm_RMSenergy", "energy", "loudness")),
    ("Spectral", ("pcm_fftMag", "audspec", "spectral", "chroma")),
    ("Temporal/ZCR", ("pcm_zcr", "voicedSegments", "unvoicedSegments", "duration", "tempo")),
    ("LSF/LPC", ("lsf", "lpc", "lsp")),
)
OTHER_CLASS = "Other"
# Patterns of the functional suffixes of feature names.
FUNCTIONALS = (
    r"amean",
    r"stddev",
    r"skewness",
    r"kurtosis",
    r"percentile\d+(\.\d+)?",
    r"min",
    r"max",
    r"range",
    r"upleveltime\d+",
    r"rlowleveltime\d+",
    r"quartile\d+",
    r"iqr\d+(-\d+)?",
    r"linregc\d+",
    r"linregerrA",
    r"linregerrQ",
    r"stddevFallingSlope",
    r"stddevRisingSlope",
    r"meanFallingSlope",
    r"meanRisingSlope",
    r"numPeaks",
    r"numSegments",
)
# Substring groups.
PROSODY_TOKENS = ("f0", "pitch", "jitter", "shimmer", "hnr", "nhr")
SPECTRAL_TOKENS = ("mfcc", "lsp", "spectral", "zcr", "energy", "loudness")

SUFFIX_PATTERN = "(?i)_(" + "|".join(FUNCTIONALS) + ")$"


def name_class(name: Column, classes=NAME_CLASSES, other: str = OTHER_CLASS) -> Column:
    """First class whose prefix list matches the name."""
    out = None
    for label, prefixes in classes:
        hit = F.lower(name).rlike("^(" + "|".join(p.lower() for p in prefixes) + ")")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(other) if out is None else out.otherwise(other)


def name_stem(name: Column, pattern: str = SUFFIX_PATTERN) -> Column:
    """The name without its functional suffix."""
    return F.regexp_replace(name, pattern, "")


def contains_any(name: Column, tokens) -> Column:
    """Case-insensitive substring test against several tokens."""
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.lower(name).contains(t.lower())
    return hit


def padded_code(prefix: str, code: Column, width: int = 4, skip: int = 1) -> Column:
    """Prefix and the number of a code such as ``P7``, zero-padded."""
    number = F.substring(code, skip + 1, 1000)
    padded = F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))
    return F.concat(F.lit(prefix), padded)


def first_part_in(path: Column, labels, sep: str = "/") -> Column:
    """Label of the first path part that is a token of ``labels`` (token -> value) or begins
    with a token and an underscore, else NULL (S2)."""

    def label(part: Column) -> Column:
        out = F.lit(None)
        for token, value in labels.items():
            hit = (part == token.lower()) | part.startswith(token.lower() + "_")
            out = F.when(hit, value).otherwise(out)
        return out

    found = F.transform(F.split(path, sep), lambda p: label(F.lower(p)))
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def part_after(path: Column, anchor, sep: str = "/") -> Column:
    """The path part that follows ``anchor``, or NULL."""
    parts = F.split(path, sep)
    at = F.array_position(parts, anchor)
    return F.when(at > 0, F.get(parts, at.cast("int")))


def subject_from(path: Column, pattern: str, unknown: str = "UNKNOWN") -> Column:
    """Upper-cased first group of a pattern, or a fixed name (S3)."""
    hit = F.upper(F.regexp_extract(path, pattern, 1))
    return F.coalesce(F.nullif(hit, F.lit("")), F.lit(unknown))


def group_of(path: Column, pattern: str, group: int) -> Column:
    """A regex group, NULL when the pattern is absent."""
    return F.nullif(F.regexp_extract(path, pattern, group), F.lit(""))


# Run-name prefixes and the sample rates they may carry.
RUN_KINDS = {
    "evaluation_features_": "Feature Evaluation",
    "evaluation_training_": "Training Evaluation",
}
RUN_RATES = ("16k", "10k", "8k")


def parse_run(name: Column) -> dict[str, Column]:
    """Kind, feature set and sample rate of a run directory name.

    Names read ``<prefix><feature set>[_<rate>]_<timestamp>``; all parts are NULL for
    a name without a known prefix.
    """
    low = F.lower(name)
    kind = F.lit(None).cast("string")
    for prefix, label in RUN_KINDS.items():
        kind = F.when(low.startswith(prefix), label).otherwise(kind)
    rest = F.regexp_replace(low, "^(" + "|".join(RUN_KINDS) + ")", "")
    rate = F.regexp_extract(rest, "_(" + "|".join(RUN_RATES) + ")_", 1)
    body = F.regexp_extract(rest, "^(.*?)(_20.*)?$", 1)
    feature_set = F.regexp_replace(body, "_(" + "|".join(RUN_RATES) + ")(?=_|$)", "")
    known = kind.isNotNull()
    return {
        "kind": kind,
        "feature_set": F.when(known, feature_set),
        "sample_rate": F.when(known, F.coalesce(F.nullif(rate, F.lit("")), F.lit("N/A"))),
    }
