"""Lookups by name: headers, labels, protocols and ports as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import cic
from tidewatch.functions.coerce import strip, whole_number


def canonical_name(name: str) -> str:
    """Header name without BOM, with every run of blanks made one space."""
    return re.sub(r"\s+", " ", name.replace("\ufeff", "")).strip()


def canonical_header(col: Column) -> Column:
    """:func:`canonical_name` for a column of header names."""
    no_bom = F.regexp_replace(col, "\ufeff", "")
    return F.trim(F.regexp_replace(no_bom, r"(?U)\s+", " "))


def literal_map(pairs: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def map_label(col: Column, label_map: Mapping[str, str | None]) -> Column:
    """Raw label to class; labels without a class become NULL."""
    text = strip(col)
    out = F.lit(None).cast("string")
    classes: dict[str, list[str]] = {}
    for raw, cls in label_map.items():
        if cls is not None:
            classes.setdefault(cls, []).append(raw)
    for cls, raws in classes.items():
        out = F.when(text.isin(*raws), F.lit(cls)).otherwise(out)
    return out


def drop_reason(col: Column, label_map: Mapping[str, str | None]) -> Column:
    """Why a label without a class was dropped."""
    known = strip(col).isin(*[k for k, v in label_map.items() if v is None])
    return F.when(known, F.lit("out of scope")).otherwise(F.lit("not in label map"))


def truth_label(col: Column, label_map: Mapping[str, str | None]) -> Column:
    """Class where the map has one, else the label text itself."""
    return F.coalesce(map_label(col, label_map), strip(col))


def protocol_name(col: Column, names: Mapping[int, str] = cic.PROTOCOLS) -> Column:
    whole = whole_number(col)
    return F.coalesce(literal_map({int(k): v for k, v in names.items()})[whole.try_cast("int")], F.concat(F.lit("PROTO-"), whole.cast("string")),
                      F.lit("UNKNOWN"))


def port_number(number: Column) -> Column:
    return number.try_cast("long")


def describe_port(number: Column, names: Mapping[int, str] = cic.WELL_KNOWN_PORTS) -> Column:
    """A port in words: its service, or the range it lies in."""
    port = port_number(number)
    service = literal_map(names)[port.try_cast("int")] if names else F.lit(None).cast("string")
    prefix = F.concat(F.lit("port "), port.cast("string"))
    return (
        F.when(number.isNull(), F.lit("no valid port"))
        .when(service.isNotNull(), F.concat(prefix, F.lit(" ("), service, F.lit(")")))
        .when(port < 1024, F.concat(prefix, F.lit(", in the system range")))
        .when(port < 49152, F.concat(prefix, F.lit(", registered but of no standard service")))
        .otherwise(F.concat(prefix, F.lit(", in the dynamic range")))
    )
