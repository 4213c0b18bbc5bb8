"""Text rules: cell keys, identifiers, labels, control probes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The name patterns of control probes.
CONTROL_PATTERNS = (
    "blank",
    "negcontrol",
    "neg_control",
    "negprobe",
    "neg_probe",
    "antisense",
    "intergenic",
    "deprecated",
    "unassigned_codeword",
    "genomic_control",
)

# Texts that mean "not assigned to a cell" (case-sensitive).
UNASSIGNED_TEXTS = ("", "0", "-1", "nan", "None", "<NA>")

# Lower-cased texts that mean "no label".
MISSING_LABELS = ("", "nan", "none", "na", "<na>")

# The broad class that is split, and the names it is split into.
NEURON_CLASS = "neurons"
NEURON_SPLIT = {"excitatory": "Excitatory neurons", "inhibitory": "Inhibitory neurons"}

DEFAULT_PIECE = "piece_1"
DERIVED_PREFIX = "_derived_"
MAX_TOKEN = 96

_BLANKS = " \t\n\r\f\x0b"
_DIGITS = r"^[+-]?\d{1,38}$"
_NUMBER = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_NON_FINITE = r"(?i)^[+-]?(inf|infinity|nan)$"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove white space of every kind at both ends."""
    return F.btrim(_c(value), F.lit(_BLANKS))


def _short_float(number: Column) -> Column:
    """Shortest text of a fractional double: plain from 1e-4 up, exponent form below."""
    text = number.cast("string")
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([\d.]+)E", 1), r"\.0$|\.", "")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^-?([\d.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E-(\d+)$", 1).try_cast("int")
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    plain = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), power - 1), digits)
    small = F.concat(sign, mantissa, F.lit("e-"), F.lpad(power.cast("string"), 2, "0"))
    return F.when(power.isNull(), text).when(power <= 4, plain).otherwise(small)


def normalize_cell_key(value: Column | str, exact: bool = True) -> Column:
    """One text per cell id, whatever type the id was stored in.

    Null and non-finite values become ``''``; whole numbers become plain integer text; other
    numbers their shortest text; anything else, and numbers of more than 38 digits, is trimmed. With ``exact`` (the default) digit
    strings never pass through a double, so 19-digit ids stay distinct; without it they do, and
    lose their low digits.
    """
    text = strip(_c(value).cast("string"))
    number = F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    whole = F.when(F.abs(number) < F.lit(2.0**63), number.try_cast("bigint").cast("string")).otherwise(
        F.coalesce(number.try_cast("decimal(38,0)").cast("string"), text)
    )
    from_double = F.when(~finite, F.lit("")).when(F.rint(number) == number, whole).otherwise(_short_float(number))
    key = F.when(text.isNull() | text.rlike(_NON_FINITE), F.lit(""))
    if exact:
        key = key.when(text.rlike(_DIGITS), F.coalesce(text.try_cast("decimal(38,0)").cast("string"), text))
    return key.when(text.rlike(_NUMBER), from_double).otherwise(text)


def is_assigned(value: Column | str, dtype: T.DataType) -> Column:
    """Whether a transcript belongs to a cell, by the type of its assignment column."""
    column = _c(value)
    if isinstance(dtype, T.NumericType):
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            column = F.nanvl(column, F.lit(0).cast(dtype))
        return F.coalesce(column > 0, F.lit(False))
    text = column.cast("string")
    return text.isNotNull() & ~text.isin(*UNASSIGNED_TEXTS)


def is_control_gene(gene: Column | str) -> Column:
    """Whether a name is that of a blank or negative-control probe."""
    return F.coalesce(F.lower(strip(gene)).rlike("|".join(CONTROL_PATTERNS)), F.lit(False))


def is_missing_label(label: Column | str) -> Column:
    text = F.lower(strip(label))
    return text.isNull() | text.isin(*MISSING_LABELS)


def split_neurons(broad: Column | str, split: Column | str) -> Column:
    """Broad class with neurons divided where the split label says how."""
    label, part = strip(broad), F.lower(strip(split))
    neuron = F.lower(label) == NEURON_CLASS
    out = None
    for name, title in NEURON_SPLIT.items():
        test = neuron & (part == name)
        out = F.when(test, F.lit(title)) if out is None else out.when(test, F.lit(title))
    return out.otherwise(label)


def _safe_token(value: Column) -> Column:
    return F.btrim(F.regexp_replace(value, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_"))


def safe_identifier(value: Column | str) -> Column:
    token = F.lower(_safe_token(_c(value)))
    return F.when(token == "", F.lit("object")).otherwise(token)


def derived_key(kind: str, value: Column | str, parameter: str, prefix: str = DERIVED_PREFIX) -> Column:
    """Private key of a derived element, e.g. an outline (``w3``) or a pyramid (``ds4``).

    A token that had to be changed or cut carries a digest of the original name.
    """
    source = _c(value)
    token = _safe_token(source)
    token = F.when(token == "", F.lit("cache")).otherwise(token)
    digest = F.substring(F.sha2(source.cast("binary"), 256), 1, 10)
    cut = F.btrim(F.substring(token, 1, MAX_TOKEN - 13), F.lit("_"))
    tagged = F.when(cut == "", F.concat(F.lit("h"), digest)).otherwise(F.concat(cut, F.lit("__h"), digest))
    safe = F.when((token == source) & (F.length(token) <= MAX_TOKEN), token).otherwise(tagged)
    return F.concat(F.lit(f"{prefix}{kind}__"), safe, F.lit(f"__{parameter}"))


def piece_id_or_default(value: Column | str) -> Column:
    text = strip(value)
    return F.when(text.isNull() | (text == ""), F.lit(DEFAULT_PIECE)).otherwise(text)
