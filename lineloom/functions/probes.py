"""Three-way tests of value tokens as columns: struct<status, normal, code>.

All are built-in expressions but IPv6, for whose canonical form Spark has none: that is an Arrow function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lineloom.functions.text import fold
from lineloom.grammar.values import REGISTRY, Declared


def _out(status: str, normal: Column | None = None, code: str | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), (F.lit(None) if normal is None else normal).cast("string").alias("normal"), F.lit(code).cast("string").alias("code"))


def _other() -> Column:
    return _out("not_applicable")


def _number(bound) -> Column:
    """A bound, stated or a column, as a wide decimal; null where there is none."""
    return (bound if isinstance(bound, Column) else F.lit(None if bound is None else str(bound))).cast("decimal(38,0)")


def _bounds(n: Column, low, high, normal: Column, under: str, over: str) -> Column:
    return F.when(n < _number(low), _out("invalid", code=under)).when(n > _number(high), _out("invalid", code=over)).otherwise(_out("valid", normal))


def integer(raw: Column, low=None, high=None) -> Column:
    """Beyond 38 digits the sign decides: such a number lies outside any bound that a format may state."""
    digits = F.regexp_replace(raw, r"^[+-]?0*(?=[0-9])", "")
    wide = F.length(digits) > 38
    n = F.when(~wide, raw.try_cast("decimal(38,0)"))
    small = raw.startswith("-")
    beyond = F.when(small & _number(low).isNotNull(), _out("invalid", code="below_minimum")).when(~small & _number(high).isNotNull(), _out("invalid", code="above_maximum")).otherwise(_out("valid", F.concat(F.when(small, "-").otherwise(""), digits)))
    return F.when(~raw.rlike(r"^[+-]?[0-9]+$"), _other()).when(wide, beyond).otherwise(_bounds(n, low, high, n, "below_minimum", "above_maximum"))


def hexadecimal(raw: Column, low=None, high=None) -> Column:
    """Exact up to 30 digits, in two halves of 15; longer ones lie above every bound."""
    digits = F.regexp_replace(F.lower(raw), r"^(0x)?0*(?=[0-9a-f])", "")
    padded = F.lpad(digits, 30, "0")
    half = lambda at: F.conv(F.substring(padded, at, 15), 16, 10).cast("decimal(20,0)")
    n = (half(1) * F.lit(str(16**15)).cast("decimal(19,0)") + half(16)).cast("decimal(38,0)")
    return F.when(~raw.rlike(r"^(0[xX])?[0-9A-Fa-f]+$"), _other()).when(F.length(digits) > 30, _out("invalid", code="above_maximum")).otherwise(_bounds(n, low, high, n, "below_minimum", "above_maximum"))


def _length(raw: Column, low, high) -> Column:
    n = F.length(raw)
    return F.when(n < _number(low), _out("invalid", code="too_short")).when(n > _number(high), _out("invalid", code="too_long")).otherwise(_out("valid", raw))


def sized(raw: Column, low=None, high=None) -> Column:
    return F.when((raw == "") | raw.rlike(r"(?U)\s"), _out("invalid", code="invalid_token")).otherwise(_length(raw, low, high))


def rest(raw: Column, low=None, high=None) -> Column:
    return _length(raw, low, high)


def enum_of(raw: Column, choices: Column) -> Column:
    """enum() with the choices in an array column."""
    at = F.array_position(F.transform(choices, fold), fold(raw))
    return F.when(at > 0, _out("valid", F.element_at(choices, F.greatest(at, F.lit(1)).cast("int")))).otherwise(_other())


def enum(raw: Column, choices: tuple[str, ...]) -> Column:
    out = F.when(F.lit(False), _other())
    for c in choices:
        out = out.when(fold(raw) == fold(F.lit(c)), _out("valid", F.lit(c)))
    return out.otherwise(_other())


def mac(raw: Column) -> Column:
    part = lambda i: F.lpad(F.lower(F.regexp_extract(raw, r"^([0-9A-Fa-f]{1,4})-([0-9A-Fa-f]{1,4})-([0-9A-Fa-f]{1,4})$", i)), 4, "0")
    return F.when(~raw.rlike(r"^[0-9A-Fa-f-]*-[0-9A-Fa-f-]*$"), _other()).when(~raw.rlike(r"^[0-9A-Fa-f]{1,4}(-[0-9A-Fa-f]{1,4}){2}$"), _out("invalid", code="invalid_mac")).otherwise(_out("valid", F.concat_ws("-", part(1), part(2), part(3))))


def ipv4(raw: Column) -> Column:
    parts = F.transform(F.split(raw, r"\."), lambda p: p.try_cast("int"))
    good = raw.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(parts, lambda p: p <= 255)
    return F.when(~raw.rlike(r"^[0-9.+-]*\.[0-9.+-]*$"), _other()).when(~good, _out("invalid", code="invalid_ipv4_address")).otherwise(_out("valid", F.array_join(F.transform(parts, lambda p: p.cast("string")), ".")))


def _calendar(raw: Column, shape: str, form: str, before: str = "") -> Column:
    """The built-in parser takes the year 0, which no calendar here has."""
    text = F.concat(F.lit(before), raw)
    year = F.lit(True) if "yyyy" not in form else F.substring(text, form.index("yyyy") + 1, 4) != "0000"
    good = F.try_to_timestamp(text, F.lit(form)).isNotNull() & year
    return F.when(~raw.rlike(f"^{shape}$"), _other()).when(~F.coalesce(good, F.lit(False)), _out("invalid", code="invalid_datetime")).otherwise(_out("valid", raw))


CALENDAR = {
    "date-slash": (r"[0-9]{4}/[0-9]{2}/[0-9]{2}", "yyyy/MM/dd", ""),
    "date-iso": (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd", ""),
    "month-day": (r"[0-9]{2}-[0-9]{2}", "yyyy-MM-dd", "2000-"),
    "date-us": (r"[0-9]{2}-[0-9]{2}-[0-9]{4}", "MM-dd-yyyy", ""),
    "datetime-slash": (r"[0-9]{4}/[0-9]{2}/[0-9]{2},[0-9]{2}:[0-9]{2}:[0-9]{2}", "yyyy/MM/dd,HH:mm:ss", ""),
    "time-seconds": (r"[0-9]{2}:[0-9]{2}:[0-9]{2}", "yyyy-MM-dd HH:mm:ss", "2000-01-01 "),
    "time": (r"[0-9]{2}:[0-9]{2}", "yyyy-MM-dd HH:mm", "2000-01-01 "),
}


def _by_registry(type_id: str):
    @F.pandas_udf("struct<status:string,normal:string,code:string>")
    def test(raw: pd.Series) -> pd.DataFrame:
        t, d = REGISTRY.types[type_id], Declared(type_id, type_id)
        found = [t.test(d, x) if x is not None else None for x in raw]
        return pd.DataFrame({"status": [p and p.status for p in found], "normal": [None if p is None or p.normal is None else str(p.normal) for p in found], "code": [p and p.code for p in found]})

    return test


def probe(d: Declared, raw: Column) -> Column:
    """The test of one declaration on a column of tokens."""
    if d.type_id in CALENDAR:
        return _calendar(raw, *CALENDAR[d.type_id])
    if d.type_id == "enum":
        return enum(raw, d.choices)
    bounded = {"integer": integer, "hex": hexadecimal, "string": sized, "passwordex": sized, "text": rest}
    if d.type_id in bounded:
        return bounded[d.type_id](raw, d.low, d.high)
    if d.type_id in ("mac", "ipv4-address"):
        return {"mac": mac, "ipv4-address": ipv4}[d.type_id](raw)
    if d.type_id == "named":
        return _out("valid", raw)
    return _by_registry(d.type_id)(raw)


#: Types whose test isn't a built-in expression.
BY_FUNCTION = tuple(t for t in REGISTRY.types if t.startswith("ipv6"))


def probe_each(type_id: Column, low: Column, high: Column, choices: Column, raw: Column) -> Column:
    """The test of declarations in columns: one expression a type, however many declarations there are. BY_FUNCTION types give null."""
    bounded = {"integer": integer, "hex": hexadecimal, "string": sized, "passwordex": sized, "text": rest}
    out = F.when(type_id == "enum", enum_of(raw, choices)).when(type_id == "named", _out("valid", raw)).when(type_id == "mac", mac(raw)).when(type_id == "ipv4-address", ipv4(raw))
    for t, test in bounded.items():
        out = out.when(type_id == t, test(raw, low, high))
    for t, how in CALENDAR.items():
        out = out.when(type_id == t, _calendar(raw, *how))
    return out


def by_function(type_id: str, raw: Column) -> Column:
    return _by_registry(type_id)(raw)
