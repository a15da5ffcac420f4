"""Lookups, keys and column selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# State by the first two digits of the municipality code.
STATE_BY_CODE = {
    "11": "RONDONIA", "12": "ACRE", "13": "AMAZONAS", "14": "RORAIMA", "15": "PARA",
    "16": "AMAPA", "17": "TOCANTINS", "21": "MARANHAO", "22": "PIAUI", "23": "CEARA",
    "24": "RIO GRANDE DO NORTE", "25": "PARAIBA", "26": "PERNAMBUCO", "27": "ALAGOAS",
    "28": "SERGIPE", "29": "BAHIA", "31": "MINAS GERAIS", "32": "ESPIRITO SANTO",
    "33": "RIO DE JANEIRO", "35": "SAO PAULO", "41": "PARANA", "42": "SANTA CATARINA",
    "43": "RIO GRANDE DO SUL", "50": "MATO GROSSO DO SUL", "51": "MATO GROSSO",
    "52": "GOIAS", "53": "DISTRITO FEDERAL",
}

# Macro category by the first level of the land-cover class.
MACRO_CATEGORIES = {
    "1.": "1. Floresta",
    "2.": "2. Vegetação Não Florestal",
    "3.": "3. Agropecuária",
    "4.": "4. Área não Vegetada",
    "5.": "5. Corpo D'água",
}
OTHER_CATEGORY = "Outros"


def state_name(code: Column) -> Column:
    """State of a municipality code, null for an unknown prefix."""
    table = F.create_map(*[F.lit(v) for pair in STATE_BY_CODE.items() for v in pair])
    return F.try_element_at(table, F.substring(code, 1, 2))


def locality_key(state: Column, municipality: Column) -> Column:
    """``STATE_MUNICIPALITY``; null if either part is null."""
    return F.concat(state, F.lit("_"), municipality)


def macro_category(land_use: Column) -> Column:
    chain = None
    for prefix, name in MACRO_CATEGORIES.items():
        hit = land_use.startswith(prefix)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(OTHER_CATEGORY)


def fill_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Fill nulls per column; a missing column is added with its default.

    Only text columns are filled: a text default cannot stay in a typed numeric column.
    """
    types = dict(df.dtypes)
    for name in defaults:
        if name not in types:
            df = df.withColumn(name, F.lit(defaults[name]))
    textual = {n: v for n, v in defaults.items() if types.get(n, "string") == "string"}
    return df.na.fill(textual)


def tolerant_select(df: DataFrame, wanted: Iterable[str], renames: Mapping[str, str] | None = None) -> DataFrame:
    """Keep the ``wanted`` columns that exist, in that order, then rename them."""
    present = df.select(*[f"`{c}`" for c in wanted if c in df.columns])
    return present.withColumnsRenamed(dict(renames or {}))


def year_columns(df: DataFrame) -> list[str]:
    """Names of the columns that are four-digit years, ascending."""
    return sorted(c for c in df.columns if len(c) == 4 and c.isdigit())


def with_latest_year(df: DataFrame, keys: Iterable[str], area: str = "area_hectares") -> DataFrame:
    """``keys`` plus the newest yearly column renamed to ``area``; only positive areas stay."""
    years = year_columns(df)
    if not years:
        raise ValueError("no yearly column found")
    latest = F.col(f"`{years[-1]}`").alias(area)
    return df.select(*[f"`{k}`" for k in keys], latest).filter(F.col(area) > 0)


def drop_missing(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """Drop rows with a null (or NaN) in ``subset``, or in any column."""
    return df.na.drop("any", subset=list(subset) if subset else None)
