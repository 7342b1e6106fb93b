"""Declarative data-quality rules, result-contract validation, step counts
and source/target reconciliation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def split_missing_id(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a usable id, rejects with null or empty id)."""
    ok = F.col(id_col).isNotNull() & (F.col(id_col) != "")
    return df.where(ok), df.where(~ok | F.col(id_col).isNull())


# ---------------------------------------------------------------- row rules

@dataclass(frozen=True)
class Rule:
    """A row-level rule: ``fails`` is true where the row violates it.

    Null handling follows SQL constraints: a CHECK whose expression is null
    passes; NOT NULL fails on null.
    """
    name: str
    fails: Column


def not_null(col: str) -> Rule:
    return Rule(f"not_null:{col}", F.col(col).isNull())


def check(name: str, predicate: Column) -> Rule:
    """CHECK constraint: violated only where the predicate is false."""
    return Rule(f"check:{name}", F.coalesce(~predicate, F.lit(False)))


def max_length(col: str, n: int) -> Rule:
    return Rule(f"length:{col}<={n}", F.coalesce(F.char_length(F.col(col)) > n, F.lit(False)))


def violated(rules: list[Rule]) -> Column:
    """ARRAY<STRING> of the names of the rules that a row violates."""
    return F.array_compact(F.array(*[F.when(r.fails, F.lit(r.name)) for r in rules]))


def with_violations(df: DataFrame, rules: list[Rule], out: str = "violations") -> DataFrame:
    """Add an ARRAY<STRING> of the names of the rules each row violates."""
    return df.withColumn(out, violated(rules))


def rule_summary(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, violations) for all row rules in one scan (one aggregate)."""
    agg = df.agg(*[F.count_if(r.fails).alias(f"r{i}") for i, r in enumerate(rules)])
    stack = ", ".join(f"'{r.name}', r{i}" for i, r in enumerate(rules))
    return agg.selectExpr(f"stack({len(rules)}, {stack}) as (rule, violations)")


# ------------------------------------------------------------ table rules

def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values occurring more than once (primary / unique / composite).

    Rows with a null key part are ignored, as a UNIQUE constraint does.
    """
    cond = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return (df.where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def orphans(child: DataFrame, parent: DataFrame, child_keys: list[str],
            parent_keys: list[str] | None = None) -> DataFrame:
    """Child rows whose (non-null) key has no parent row.

    Left-anti join on the key; a null foreign key passes.  Only the key
    columns of the parent are read.
    """
    parent_keys = parent_keys or child_keys
    p = parent.select(*[F.col(pk).alias(ck) for pk, ck in zip(parent_keys, child_keys)])
    cond = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in child_keys])
    return child.where(cond).join(p, child_keys, "left_anti")


# --------------------------------------------------- scored-result contract

# The fields of a scored result.
SCORED_REQUIRED = ["transaction_id", "original_data", "prediction", "fraud_probability",
                   "is_fraud", "model_version", "scored_at"]


def scored_rules(df: DataFrame) -> list[Rule]:
    rules = []
    for c in SCORED_REQUIRED:
        rules.append(Rule(f"missing:{c}", F.col(c).isNull()) if c in df.columns
                     else Rule(f"missing:{c}", F.lit(True)))
    cols = set(df.columns)
    if "prediction" in cols:
        rules.append(Rule("prediction_in_0_1", F.coalesce(~F.col("prediction").isin(0, 1), F.lit(False))))
    if "fraud_probability" in cols:
        p = F.col("fraud_probability")
        rules.append(Rule("probability_in_0_1", F.coalesce((p < 0) | (p > 1) | F.isnan(p), F.lit(False))))
    if {"is_fraud", "prediction"} <= cols:
        rules.append(Rule("is_fraud_matches_prediction",
                          F.coalesce(F.col("is_fraud") != (F.col("prediction") == 1), F.lit(False))))
    if "scored_at" in cols:
        rules.append(Rule("scored_at_iso",
                          F.col("scored_at").isNotNull() & F.try_to_timestamp(F.col("scored_at").cast("string")).isNull()))
    return rules


def validate_scored(df: DataFrame) -> DataFrame:
    """Add ``violations`` and ``is_valid`` for the scored-record contract."""
    out = with_violations(df, scored_rules(df))
    return out.withColumn("is_valid", F.size("violations") == 0)


#: types of a field of a raw message, as the contract takes them: whole numbers and truth values count as numbers
WHOLE = r"BIGINT|BOOLEAN"
NUMBER = r"BIGINT|BOOLEAN|DOUBLE|DECIMAL\(.*\)"


#: the fields whose number, and whose truth value or time, the contract looks at
NUMBERS = ["prediction", "fraud_probability"]


def message_parts(value: Column) -> Column:
    """What the rules ask of a raw JSON message, each worked out once: a struct of ``object``, ``kind_*``, ``number_*``, ``flag``, ``stamp``.

    The message is parsed once as a VARIANT, which keeps how a value was
    written: ``1``, ``1.0``, ``"1"`` and ``true`` are a whole number, a
    decimal, a text and a truth value.  A field that is there but null has no
    type.
    """
    def parts(v: Column) -> Column:
        number = lambda c: F.try_variant_get(v, f"$.{c}", "double")
        return F.struct(
            F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("object"),
            *[F.schema_of_variant(F.variant_get(v, f"$.{c}", "variant")).alias(f"kind_{c}") for c in SCORED_REQUIRED],
            *[number(c).alias(f"number_{c}") for c in NUMBERS],
            F.try_variant_get(v, "$.is_fraud", "boolean").alias("flag"),
            F.try_to_timestamp(F.try_variant_get(v, "$.scored_at", "string")).alias("stamp"))

    return _once(F.try_parse_json(value), parts)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` bound to a name: it is worked out once a row however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def message_rules(m: Column) -> list[Rule]:
    """Contract of a scored result on the parts ``m`` of its raw JSON text (``message_parts``), types included.

    Only a message with all fields is looked into; text that is no JSON
    object, or repeats a field, is unparseable.
    """
    is_object = m["object"]
    kind, number = lambda c: m[f"kind_{c}"], lambda c: m[f"number_{c}"]
    typed = lambda c, pattern: F.coalesce(kind(c).rlike(f"^({pattern})$"), F.lit(False))
    missing = {c: is_object & kind(c).isNull() for c in SCORED_REQUIRED}
    whole = is_object
    for c in SCORED_REQUIRED:
        whole = whole & kind(c).isNotNull()
    zero_or_one = typed("prediction", WHOLE) & number("prediction").isin(0.0, 1.0)
    return [
        Rule("unparseable", ~is_object),
        *[Rule(f"missing:{c}", gone) for c, gone in missing.items()],
        Rule("prediction_int", whole & ~typed("prediction", WHOLE)),
        Rule("prediction_in_0_1", whole & typed("prediction", WHOLE) & ~number("prediction").isin(0.0, 1.0)),
        Rule("probability_number", whole & ~typed("fraud_probability", NUMBER)),
        Rule("probability_in_0_1", whole & typed("fraud_probability", NUMBER) & ~number("fraud_probability").between(0, 1)),
        Rule("is_fraud_boolean", whole & ~typed("is_fraud", "BOOLEAN")),
        Rule("is_fraud_matches_prediction", whole & typed("is_fraud", "BOOLEAN") & zero_or_one & (m["flag"] != (number("prediction") == 1.0))),
        Rule("model_version_int_or_text", whole & ~typed("model_version", f"{WHOLE}|STRING")),
        Rule("scored_at_iso", whole & (~typed("scored_at", "STRING") | m["stamp"].isNull()))]


def validate_messages(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Add ``violations`` and ``is_valid`` for raw JSON messages (``message_rules``); a null message is unparseable."""
    out = df.withColumn("violations", _once(message_parts(F.col(value_col)), lambda m: violated(message_rules(m))))
    return out.withColumn("is_valid", F.size("violations") == 0)


# ------------------------------------------------------------- step counts

def observe_counts(df: DataFrame, name: str, extra: dict[str, Column] | None = None
                   ) -> tuple[DataFrame, Observation]:
    """Attach a row counter (and extra metrics) that is filled by the next
    action on the returned frame — no separate ``count()`` pass."""
    obs = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")]
    for k, v in (extra or {}).items():
        metrics.append(v.alias(k))
    return df.observe(obs, *metrics), obs


# ----------------------------------------------------------- reconciliation

def fingerprint_columns(df: DataFrame) -> list[Column]:
    """Aggregates: row count and an order-independent checksum of all rows.

    ``bit_xor`` of a 64-bit row hash is commutative, so it is computed with a
    partial aggregate per task and does not depend on partitioning.  Rows
    that occur twice cancel in the XOR, so the sum of the whole hashes is
    kept too (as a decimal, which holds any number of them).
    """
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return [F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash")]


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row of ``fingerprint_columns``."""
    return df.agg(*fingerprint_columns(df))


def reconcile(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Per table: source rows, target rows, and whether column names, types and both fingerprints agree.

    Both fingerprints are one-row aggregates; they are stacked and folded
    with a conditional aggregate (no join).
    """
    parts = []
    for name, (src, dst) in pairs.items():
        both = (table_fingerprint(src).withColumn("side", F.lit("s"))
                .unionByName(table_fingerprint(dst).withColumn("side", F.lit("d"))))

        def pick(c, side):
            return F.max(F.when(F.col("side") == side, F.col(c)))

        parts.append(both.agg(
            pick("rows", "s").alias("source_rows"), pick("rows", "d").alias("target_rows"),
            pick("xor_hash", "s").alias("sx"), pick("xor_hash", "d").alias("dx"),
            pick("sum_hash", "s").alias("ss"), pick("sum_hash", "d").alias("ds"),
        ).select(
            F.lit(name).alias("table_name"), "source_rows", "target_rows",
            (F.lit(src.dtypes == dst.dtypes) & (F.col("source_rows") == F.col("target_rows"))
             & F.col("sx").eqNullSafe(F.col("dx"))
             & F.col("ss").eqNullSafe(F.col("ds"))).alias("matches")))
    return reduce(DataFrame.unionByName, parts)
