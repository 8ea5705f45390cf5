"""Cleaning and derivation as column expressions: nothing here touches data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: structural sentinel codes of the releases, and codes that only some fields use
SENTINELS = ("-77771", "-77772", "-88880", "-88888", "-99991", "-99993", "-99999")
NUMERIC_MISSING = ("-8",)
ACUITY_MISSING = ("-8", "-88.8")
SMOKING_MISSING = ("-8", "8", "9")
SURVEY_MISSING = ("8", "9")
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")
YES_NO = {
    "release": (("1", "11", "Y", "YES", "TRUE"), ("0", "2", "N", "NO", "FALSE")),
    "screen": (("1", "1.0", "11", "11.0", "Y", "YES", "TRUE"), ("2", "2.0", "N", "NO", "FALSE")),
    "indicator": (("1", "1.0", "11", "Y", "YES", "TRUE", "T"), ("0", "0.0", "2", "2.0", "N", "NO", "FALSE", "F")),
}
EYES = {"OD": "R", "RIGHT": "R", "R": "R", "OS": "L", "LEFT": "L", "L": "L", "OU": "BOTH"}
COMPOUND_EXTENSIONS = (".bgen.bgi", ".csv.gz", ".txt.gz")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".dcm")
TABULAR_EXTENSIONS = (".csv", ".csv.gz", ".tsv", ".txt", ".txt.gz", ".xlsx", ".xls")
GENETIC_EXTENSIONS = (".bgen", ".bgen.bgi", ".bed", ".bim", ".fam", ".sample")
DOCUMENT_EXTENSIONS = (".md", ".pdf", ".doc", ".docx")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


# codes and numbers


def clean_code(value: Column, extra: Sequence[str] = ()) -> Column:
    """Trimmed, a trailing ``.0`` dropped, sentinels and ``extra`` codes to null."""
    code = F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")
    return F.when(~code.isin(*SENTINELS, *extra), code)


def clean_numeric(value: Column, extra: Sequence[str] = ()) -> Column:
    """A cleaned code as a double; null where it is no number."""
    return clean_code(value, extra).try_cast("double")


def yes_no(value: Column, variant: str = "release") -> Column:
    """1, 0 or null (unknown) by one of the three vocabularies."""
    yes, no = YES_NO[variant]
    code = F.upper(clean_code(value) if variant == "release" else F.trim(value.cast("string")))
    return F.when(code.isin(*yes), 1).when(code.isin(*no), 0)


def any_positive(*flags: Column) -> Column:
    """1 if any flag is 1, else 0 if any is known, else null."""
    positive = reduce(lambda a, b: a | b, [F.coalesce(f == 1, F.lit(False)) for f in flags])
    return F.when(positive, 1).when(F.coalesce(*flags).isNotNull(), 0)


def combine_binary(*flags: Column) -> Column:
    """1 if any flag is 1, else 0 if any is exactly 0, else null."""
    def has(x: int) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(f == x, F.lit(False)) for f in flags])

    return F.when(has(1), 1).when(has(0), 0)


def selected_count(*flags: Column) -> Column:
    """Sum of flags with unknown as 0; null if nothing is known."""
    return F.when(F.coalesce(*flags).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(0)) for f in flags]))


def level_flag(code: Column, high: Sequence[float], low: Sequence[float]) -> Column:
    return F.when(code.isin(*high), 1).when(code.isin(*low), 0)


def threshold_flag(value: Column, at: float, strict: bool = False) -> Column:
    """1 from ``at`` on (above it if strict), 0 below, null if unknown."""
    return F.when(value.isNull(), _null("int")).when(value > at if strict else value >= at, 1).otherwise(0)


def recode(value: Column, groups: Mapping[object, Sequence]) -> Column:
    """Many-to-one recoding: {new: (old, ...)}; anything else is null."""
    out = None
    for new, old in groups.items():
        out = F.when(value.isin(*old), new) if out is None else out.when(value.isin(*old), new)
    return out


# times and proxies


def parse_timestamp(value: Column) -> Column:
    """The first of the known formats that fits."""
    return F.coalesce(F.try_to_timestamp(value), *[F.try_to_timestamp(value, F.lit(f)) for f in TIMESTAMP_FORMATS])


def first_known(sources: Mapping[str, Column], absent: str = "unavailable") -> tuple[Column, Column]:
    """(first non-null value, name of its source), in the order given."""
    label = None
    for name, value in sources.items():
        label = F.when(value.isNotNull(), name) if label is None else label.when(value.isNotNull(), name)
    return F.coalesce(*sources.values()), label.otherwise(absent)


# identities and places


def visit_code(value: Column) -> Column:
    v = F.upper(F.trim(value))
    return F.when(v.isin("F1", "FUP1"), "F1").when(v == "BL", "BL")


#: Words of releases for a sex. Any other word is kept behind OTHER:.
SEX_WORDS = {"F": ["F", "FEMALE", "2", "2.0", "WOMAN"], "M": ["M", "MALE", "1", "1.0", "MAN"], "MISSING": ["", "NAN", "NONE", "NULL", "8", "9", "-8", "-9"]}


def coded(value: Column, words: Mapping[str, list[str]]) -> Column:
    """The code whose words a value is among, or null: one look-up in a constant map."""
    pairs = [F.lit(x) for code, own in words.items() for w in own for x in (w, code)]
    return F.try_element_at(F.create_map(*pairs), value)


def sex_code(value: Column) -> Column:
    word = F.upper(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.coalesce(coded(word, SEX_WORDS), F.concat(F.lit("OTHER:"), word))


def eye_code(value: Column) -> Column:
    """R, L or BOTH; other words in upper case."""
    v = F.upper(F.trim(value))
    table = F.create_map(*[F.lit(x) for pair in EYES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, v), v)


def id_text(value: Column) -> Column:
    return F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")


def valid_id(value: Column, pattern: str = r"^\d{7}$") -> Column:
    return F.coalesce(value.rlike(pattern), F.lit(False))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension, compound ones kept whole; empty if there is none."""
    name = F.lower(file_name(path))
    compound = "|".join(e.replace(".", r"\.") for e in COMPOUND_EXTENSIONS)
    return F.coalesce(F.nullif(F.regexp_extract(name, f"({compound})$", 1), F.lit("")), F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


#: Classes of archive members, (class, extensions, what the file name must hold). The first row that fits wins.
MEMBER_CLASSES = [
    ("fundus_image", IMAGE_EXTENSIONS, ""),
    ("data_dictionary", (".xlsx", ".xls"), "dictionar"),
    ("tabular_data", TABULAR_EXTENSIONS, ""),
    ("genetics", GENETIC_EXTENSIONS, ""),
    ("documentation", DOCUMENT_EXTENSIONS, ""),
    ("nested_archive", (".zip", ".7z"), ""),
]


def member_class(path: Column) -> Column:
    """The first class of ``MEMBER_CLASSES`` that a path fits, else other."""
    ending, name = extension(path), F.lower(file_name(path))
    fits = [F.when(ending.isin(*endings) & name.contains(part), kind) for kind, endings, part in MEMBER_CLASSES]
    return F.coalesce(*fits, F.lit("other"))


def path_identity(path: Column, pattern: str = r"(?i)(?:^|/)(\d{7})/retinal_(left|right)\.jpe?g$") -> tuple[Column, Column]:
    """(identifier, eye) that a path names; null where it doesn't fit."""
    who = F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    return who, eye_code(F.nullif(F.regexp_extract(path, pattern, 2), F.lit("")))


def stable_key(value: Column, length: int = 24, algorithm: str = "sha256") -> Column:
    digest = F.sha2(value, 256) if algorithm == "sha256" else F.sha1(value)
    return F.substring(digest, 1, length)


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")


# groups and bands


def multi_response(indicators: Mapping[str, Column]) -> dict[str, Column]:
    """One label from several 1/0/null indicators: label, detail, selection_count, status, eligible."""
    picked = F.filter(F.array(*[F.when(c == 1, name) for name, c in indicators.items()]), lambda x: x.isNotNull())
    known = F.coalesce(*indicators.values()).isNotNull()
    n = F.size(picked)
    label = F.when(n == 1, F.try_element_at(picked, F.lit(1))).when(n > 1, "Multiple groups")
    status = F.when(n == 1, "single_released_group").when(n > 1, "multiple_released_groups").when(known, "no_released_group_selected").otherwise("all_indicators_missing_or_unknown")
    return {"label": label, "detail": F.when(n > 0, F.array_join(F.array_sort(picked), " | ")), "selection_count": n, "status": status, "eligible": label.isNotNull()}


def band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-open bins [edge, next); null below the first edge, above the last if labels end there, and for null."""
    out = F.when(value < edges[0], _null("string"))
    for high, label in zip(edges[1:], labels, strict=False):
        out = out.when(value < high, label)
    return out.when(value.isNotNull(), labels[-1]) if len(labels) == len(edges) else out


def age_band(age: Column) -> Column:
    return band(age, (45, 55, 65, 75), ("45-54", "55-64", "65-74", "75+"))


def count_band(n: Column) -> Column:
    return F.when(n >= 3, "3+").when(n >= 0, n.cast("int").cast("string"))


def confusion_cell(truth: Column, score: Column, at: float = 0.5) -> Column:
    return F.when((truth == 1) & (score >= at), "TP").when((truth == 1) & (score < at), "FN").when((truth == 0) & (score >= at), "FP").when((truth == 0) & (score < at), "TN")


# audits


def formula_audit(released: Column, recomputed: Column, tolerance: float, low: float, high: float) -> dict[str, Column]:
    """Difference of a released value and its recomputation, with a tolerance and a range status."""
    difference = released - recomputed
    status = F.when(released.isNull(), "released_missing").when(recomputed.isNull(), "components_missing").when(F.abs(difference) <= tolerance, "consistent").otherwise("review_difference")
    ranges = F.when(released.isNull(), "missing").when(released.between(low, high), "within_range").otherwise("review_out_of_range")
    return {"difference": difference, "status": status, "range_status": ranges}


def elapsed_audit(age_before: Column, age_after: Column, date_before: Column, date_after: Column, tolerance: float = 1.0) -> dict[str, Column]:
    """Age increment against elapsed years."""
    grown, elapsed = age_after - age_before, F.months_between(date_after, date_before) / 12.0
    status = F.when(grown.isNull(), "insufficient_age_data").when(grown < 0, "review_age_decrease").when(elapsed.isNull(), "age_available_date_proxy_missing").when(F.abs(grown - elapsed) <= tolerance, "consistent_with_date_proxy").otherwise("review_age_date_difference")
    return {"increment": grown, "elapsed": elapsed, "status": status}


def quality_gate(rules: Mapping[str, Column]) -> tuple[Column, Column]:
    """(pass, reasons joined by ``|``) from {reason: fails}; an unknown measure fails no rule."""
    reasons = F.filter(F.array(*[F.when(fails, name) for name, fails in rules.items()]), lambda x: x.isNotNull())
    return F.size(reasons) == 0, F.array_join(reasons, "|")


# fixed values: image quality limits (measure, reason, bound, whether the bound is a minimum)
QUALITY_LIMITS = (
    ("min_dimension", "dimension_below_minimum", 224.0, True),
    ("retina_fraction", "retina_fraction_below_minimum", 0.01, True),
    ("brightness_mean", "too_dark", 10.0, True),
    ("brightness_mean", "too_bright", 245.0, False),
    ("contrast_std", "low_contrast", 5.0, True),
    ("gradient_energy", "low_sharpness", 2.0, True),
    ("dark_fraction", "dark_clipping", 0.90, False),
    ("bright_fraction", "bright_clipping", 0.90, False),
)


def image_quality(measures: Mapping[str, Column]) -> tuple[Column, Column]:
    return quality_gate({reason: measures[m] < at if low else measures[m] > at for m, reason, at, low in QUALITY_LIMITS})


# fixed values: words of quality flags
PASS_WORDS = ("1", "true", "t", "y", "yes", "pass", "passed", "gradable", "usable")
FAIL_WORDS = ("0", "false", "f", "n", "no", "fail", "failed", "ungradable", "unusable")


def closed_flag(value: Column, strict: bool = True) -> Column:
    """true for a pass word, false for a fail word or null; any other word is an error (null if not strict)."""
    word = F.lower(F.trim(F.regexp_replace(value.cast("string"), r"\.0$", "")))
    other = F.raise_error(F.concat(F.lit("unknown flag: "), word)).cast("boolean") if strict else _null("boolean")
    return F.when(word.isin(*PASS_WORDS), True).when(word.isNull() | word.isin(*FAIL_WORDS), False).otherwise(other)


def json_text(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))


def complete_case(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns]).cast("int")


def same(a: Column, b: Column) -> Column:
    """Null-safe equality as 1/0."""
    return a.eqNullSafe(b).cast("int")


# metadata-driven projection


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that is there: exactly, else whatever its case."""
    folded = {c.casefold(): c for c in columns}
    for c in candidates:
        if c in columns:
            return c
        if c.casefold() in folded:
            return folded[c.casefold()]
    return None


def id_column(df: DataFrame, candidates: Sequence[str]) -> str:
    if (found := pick_column(df.columns, candidates)) is None:
        raise ValueError(f"none of {list(candidates)} is a column")
    return found


def normalized_names(df: DataFrame) -> DataFrame:
    """Headers of letters, digits and single underscores; clashes (case aside) get _2, _3, ..."""
    import re

    taken: set[str] = set()
    out = []
    for name in df.columns:
        base = re.sub("[^A-Za-z0-9]+", "_", name).strip("_") or "column"
        new, n = base, 1
        while new.casefold() in taken:
            n += 1
            new = f"{base}_{n}"
        taken.add(new.casefold())
        out.append(new)
    return df.toDF(*out)


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column if it is there, else a typed null."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else _null(kind).alias(name)


def harmonize(df: DataFrame, cohort: str, manifest: Mapping[str, Mapping[str, Sequence[str]]], ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Projection to the manifest's names, all strings: (rows, audit of which source column served).

    ``manifest`` maps a standard name to {cohort: source candidates in order}.
    """
    who, chosen, audit = id_column(df, ids), [], []
    for name, by_cohort in manifest.items():
        source = pick_column(df.columns, by_cohort.get(cohort, ()))
        chosen.append((F.col(f"`{source}`").cast("string") if source else _null("string")).alias(name))
        audit.append((cohort, name, source, "mapped" if source else "not_available"))
    rows = df.select(F.col(f"`{who}`").cast("string").alias("participant_id"), F.lit(cohort).alias("cohort"), *chosen)
    return rows, df.sparkSession.createDataFrame(audit, "cohort string, standard_name string, source_column string, status string")


def project_visit(df: DataFrame, visit: str, source: str, columns: Mapping[str, str], id_name: str) -> DataFrame:
    """Rows of one visit with provenance; columns that the release lacks are typed nulls."""
    picked = [(F.col(f"`{c}`").cast("string") if c in df.columns else _null("string")).alias(name) for name, c in columns.items()]
    return df.select(F.trim(F.col(f"`{id_name}`").cast("string")).alias("participant_id"), F.lit(visit).alias("visit"), F.lit(source).alias("source_release"), *picked)
