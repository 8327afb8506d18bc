"""Column expressions: names, entities, hashes, clamps, parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: ASCII white space; values of every span are stripped of it, which a regular expression takes many times as long for.
EDGE_SPACE = " \t\n\v\f\r"


def col(x) -> Column:
    return F.col(f"`{x}`") if isinstance(x, str) else x


def strip(x) -> Column:
    return F.btrim(col(x), F.lit(EDGE_SPACE))


def entity(kind: str, value) -> Column:
    """``kind:value``, the value stripped."""
    return F.concat(F.lit(kind + ":"), strip(value))


def entity_kind(x) -> Column:
    """What stands before the first colon; ``service`` if there is none."""
    return F.when(F.contains(col(x), F.lit(":")), F.substring_index(col(x), ":", 1)).otherwise("service")


def entity_value(x) -> Column:
    """What stands behind the first colon; all if there is none."""
    return F.expr(f"substring({_sql(x)}, locate(':', {_sql(x)}) + 1)") if isinstance(x, str) else F.substring(x, F.locate(":", x) + 1, F.length(x))


def _sql(x: str) -> str:
    return f"`{x}`"


def clean(x) -> Column:
    """Null for null, NaN, blank and the words none, null and nan; else the stripped string."""
    s = strip(col(x).cast("string"))
    return F.when((s != "") & ~F.lower(s).isin("none", "null", "nan"), s)


def first_column(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The first of the names that the frame has: chosen once per frame, not per row."""
    return next((n for n in names if n in df.columns), None)


def observation_id(kind, source, target) -> Column:
    return F.concat(F.lit("ro-"), F.substring(F.sha2(F.concat_ws("|", col(kind), col(source), col(target)), 256), 1, 16))


def mask_rank(seed, salt, source="source", relation="relation", target="target") -> Column:
    """A hash by which edges are ordered for masking."""
    edge = F.concat_ws("|", col(source), col(relation), col(target))
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), col(salt), edge), 256)


def normalize_service(x) -> Column:
    """Strip, lower, drop one service prefix, drop ``ts-``, drop dashes and underscores: in this order."""
    s = F.lower(strip(x))
    s = F.regexp_replace(F.regexp_replace(s, "^(service|svc)[:/]", ""), "^ts-", "")
    return F.translate(s, "-_", "")


def is_loadgen(x) -> Column:
    return F.contains(normalize_service(x), F.lit("loadgen"))


def clip01(x) -> Column:
    """Into [0, 1]; null stays null, NaN and infinities become 0."""
    x = col(x)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def seconds(df: DataFrame, name: str) -> Column:
    """Epoch seconds of a time column: timestamps exactly, numbers as nanoseconds, anything else null."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(col(name).cast("timestamp")) / 1e6
    return F.expr(f"try_cast({_sql(name)} AS DOUBLE)") / 1e9


def to_number(x: str) -> Column:
    """A number, or null for text that is none and for NaN."""
    v = F.expr(f"try_cast({_sql(x)} AS DOUBLE)")
    return F.when(~F.isnan(v), v)


def half_even(x) -> Column:
    return F.rint(col(x)).cast("long")


def ratio_of(a, b, empty: float | None = 0.0) -> Column:
    """a / b; ``empty`` when b is 0."""
    return F.when(col(b) != 0, col(a) / col(b)).otherwise(F.lit(empty))


def compact(x) -> Column:
    return F.trim(F.regexp_replace(col(x), "\\s+", " "))


def ratio_label(x) -> Column:
    return F.concat(F.rint(col(x) * 100).cast("int").cast("string"), F.lit("%"))


def structural_text(count="observation_count") -> Column:
    """An observation as a sentence for a language model."""
    detail = F.when(strip("text") != "", strip("text")).otherwise(F.col("evidence_kind"))
    return F.concat(
        F.lit("["), F.col("source"), F.lit(" -> "), F.col("target"), F.lit("] "), detail, F.lit(" evidence_kind="), F.col("evidence_kind"),
        F.lit("; confidence="), fixed(F.col("confidence")), F.lit("; count="), col(count).cast("string"), F.lit("."),
    )


def fixed(x: Column, digits: int = 3) -> Column:
    """A number with so many decimals, rounded half up on its decimal form."""
    return F.format_string(f"%.{digits}f", x)


def evidence_text() -> Column:
    """A piece of evidence as a sentence for a language model."""
    detail = F.when(strip(F.coalesce("text", F.lit(""))) != "", strip("text")).otherwise(F.concat("kind", F.lit(" signal "), "signal"))
    at = F.when(F.col("ts_s").isNotNull(), F.concat(F.lit(" at time "), fixed(F.col("ts_s")))).otherwise("")
    state = F.when(F.col("abnormality") >= 0.5, "abnormal").otherwise("normal")
    return F.concat(
        F.lit("["), F.col("node"), F.lit("] "), detail, F.lit("; state="), state, F.lit("; abnormality="), fixed(F.col("abnormality")), at, F.lit(".")
    )
