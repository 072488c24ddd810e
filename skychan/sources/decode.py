"""Typing, decoding and code lookups (T1-T8) as narrow projections."""
from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import (ANGLE_NAMES, CODE_COLUMNS, LINK_STATE_NAMES, NULL_TOKENS, RX_SPELLINGS,
                      SPEC, observation_schema, spark_type)

JSON_OPTS = {"allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}


def null_tokens(c: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """NA-like strings -> NULL (S2). Spark's CSV ``nullValue`` takes one token only."""
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def decode_scalar(c: Column, name: str, src_type: T.DataType | None = None) -> Column:
    """Cast a scalar cell to its declared type; a bad value becomes NULL.

    Code columns (stored as uint8 by the reference) are range-checked to 0-255 (P16)."""
    target = spark_type(name)
    if src_type is None or isinstance(src_type, T.StringType):
        cell = F.trim(null_tokens(c))
        v = cell.try_cast(target)
        if name in CODE_COLUMNS:  # a column of codes with gaps is often written as 1.0
            d = cell.try_cast("double")
            v = F.coalesce(v, F.when(d == F.floor(d), d.try_cast(target)))
    else:
        v = c.try_cast(target)
    if name in CODE_COLUMNS:
        v = F.when((v >= 0) & (v <= 255), v)
    return v


#: A whole array of depth 1 or 2: the JSON reader stops behind the first one and would accept what follows.
ONE_ARRAY = r"^\s*\[([^\[\]]*|\s*\[[^\[\]]*\]\s*(,\s*(\[[^\[\]]*\]|null)\s*)*|\s*null\s*(,\s*(\[[^\[\]]*\]|null)\s*)*)\]\s*$"


def decode_array(c: Column, name: str, src_type: T.DataType | None = None) -> Column:
    """JSON text -> typed array; malformed, truncated, scalar or object JSON and
    ``NaN`` tokens -> NULL (T2-T4). Already-decoded arrays are cast (T5)."""
    target = spark_type(name)
    if src_type is not None and isinstance(src_type, T.ArrayType):
        return c.try_cast(target)
    text = null_tokens(c)
    return F.when(text.rlike(ONE_ARRAY), F.from_json(text, target, JSON_OPTS))


def decode_column(c: Column, name: str, src_type: T.DataType | None = None) -> Column:
    """Dispatch on the declared shape and on the source type, not on a data peek (T5)."""
    if SPEC[name][1]:
        return decode_array(c, name, src_type)
    return decode_scalar(c, name, src_type)


def decode_observations(df: DataFrame, keep: Iterable[str] = ("obs_id", "_source_file"),
                        with_rejects: bool = False) -> DataFrame:
    """Typed observation table from raw cells, columns matched by name.

    With ``with_rejects`` every declared column ``c`` gets a boolean
    ``c__reject``: a non-null, non-token cell that did not decode (P17)."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    cols = [F.col(k) if k != "obs_id" else F.col(k).cast("bigint").alias("obs_id") for k in keep if k in types]
    kept, there = [k for k in keep if k in types], []
    for name in SPEC:
        if name not in types:
            cols.append(F.lit(None).cast(spark_type(name)).alias(name))
            continue
        cols.append(decode_column(F.col(name), name, types[name]).alias(name))
        if with_rejects:
            raw = F.col(name)
            present = raw.isNotNull() if not isinstance(types[name], T.StringType) else null_tokens(raw).isNotNull()
            there.append((name, present.alias(f"_{name}__there")))
    if not there:
        return df.select(*cols)
    # flags by the decoded columns, a projection above them: in one projection each cell would be decoded twice
    decoded = df.select(*cols, *[p for _, p in there])
    return decoded.select(*kept, *SPEC, *[(F.col(f"_{c}__there") & F.col(c).isNull()).alias(f"{c}__reject") for c, _ in there])


def reject_counts(decoded: DataFrame) -> DataFrame:
    """One row per declared column: cells rejected by the decoder (T4)."""
    flags = [c for c in decoded.columns if c.endswith("__reject")]
    sums = decoded.agg(*[F.sum(F.col(c).cast("bigint")).alias(c[:-8]) for c in flags])
    stack = ", ".join(f"'{c[:-8]}', `{c[:-8]}`" for c in flags)
    return sums.selectExpr(f"stack({len(flags)}, {stack}) as (column, n_rejects)")


# ---------------------------------------------------------------- code lookups
def normalize_rx(c: Column, on_unknown: str = "error") -> Column:
    """Receiver code/spelling -> name (T6, P23): ``0``/``"0"``/``Terrestrial`` ->
    Terrestrial, ``1``/``"1"``/``Aerial`` -> Aerial; unknown raises or is NULL."""
    m = F.create_map(*[F.lit(x) for kv in RX_SPELLINGS.items() for x in kv])
    key = F.trim(c.cast("string"))
    name = F.try_element_at(m, key)
    if on_unknown == "null":
        return name
    if on_unknown == "error":
        return F.when(c.isNull(), F.lit(None).cast("string")).when(
            F.map_contains_key(m, key), name).otherwise(
            F.raise_error(F.concat(F.lit("unknown receiver type: "), key)).cast("string"))
    raise ValueError("on_unknown must be 'error' or 'null'")


def link_state_label(code: Column) -> Column:
    """Code -> NO_LINK / NLOS / LOS."""
    return F.when((code >= 0) & (code < len(LINK_STATE_NAMES)),
                  F.element_at(F.array(*[F.lit(n) for n in LINK_STATE_NAMES]), code + 1))


def _label_to_code(label: Column, names: Sequence[str]) -> Column:
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n.lower()), F.lit(i))])
    return F.try_element_at(m, F.lower(label)).cast("int")


def link_state_code(label: Column) -> Column:
    """Case-insensitive label -> code; unknown -> NULL."""
    return _label_to_code(label, LINK_STATE_NAMES)


def angle_index(label: Column) -> Column:
    """Case-insensitive angle name -> slot 0-3; unknown -> NULL."""
    return _label_to_code(label, ANGLE_NAMES)


# ---------------------------------------------------------------- concatenate
def concat_parts(parts: Sequence[DataFrame], spark=None) -> DataFrame:
    """Row-bind parts by name (T8, P18): the column set is that of the first
    part, a part missing a column contributes NULLs. Numbers widen; a column of
    otherwise differing types becomes text (JSON for nested values)."""
    if not parts:
        if spark is None:
            raise ValueError("spark is needed to build an empty table")
        return spark.createDataFrame([], observation_schema())
    first = parts[0].columns
    kinds = {c: [p.schema[c].dataType for p in parts if c in p.columns] for c in first}
    as_text = {c for c, k in kinds.items()
               if len({t.simpleString() for t in k}) > 1 and not all(isinstance(t, T.NumericType) for t in k)}

    def cell(p: DataFrame, c: str) -> Column:
        if c not in p.columns:
            return F.lit(None).cast(T.StringType() if c in as_text else kinds[c][0]).alias(c)
        v = F.col(f"`{c}`")
        if c in as_text:
            v = F.to_json(v) if isinstance(p.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else v.cast("string")
        return v.alias(c)

    return reduce(lambda a, b: a.unionByName(b), [p.select(*[cell(p, c) for c in first]) for p in parts])
