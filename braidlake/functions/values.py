"""Column functions with the semantics of an embedded SQL engine where Spark's differ."""

from __future__ import annotations

from pyspark.sql import functions as F


def int_div(a, b):
    """Integer division that truncates; null on division by zero."""
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def scalar_least(*columns):
    """Least of its arguments, null if any is null."""
    return F.when(~_any_null(columns), F.least(*columns))


def scalar_greatest(*columns):
    return F.when(~_any_null(columns), F.greatest(*columns))


def _any_null(columns):
    out = F.lit(False)
    for c in columns:
        out = out | c.isNull()
    return out


def total(column):
    """Sum as a double, 0.0 without rows."""
    return F.coalesce(F.sum(column.cast("double")), F.lit(0.0))


def storage_class(column, kind: str):
    """'null', 'integer', 'real', 'text' or 'blob'."""
    names = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "boolean": "integer", "float": "real", "double": "real", "binary": "blob"}
    return F.when(column.isNull(), F.lit("null")).otherwise(F.lit(names.get(kind, "text")))


def glob(column, pattern: str):
    """Case-sensitive match of * ? [..] over the whole text."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += "[\\s\\S]*"
        elif c == "?":
            out += "[\\s\\S]"
        elif end > 0:
            out += "[" + pattern[k + 1 : end].replace("\\", "\\\\") + "]"
            k = end
        else:
            out += "\\" + c if not c.isalnum() and ord(c) < 128 else c
        k += 1
    return column.rlike("^" + out + "\\z")


def number_key(integer, real):
    """Sort key of mixed numbers that compares integers and reals exactly: (band, whole part, fraction)."""
    big = F.lit(9223372036854775808.0)
    band = F.when(real >= big, 1).when(real < -big, -1).otherwise(0)
    whole = F.coalesce(integer, F.when(band == 0, F.floor(real).cast("long")), F.lit(0).cast("long"))
    part = F.when(real.isNull(), F.lit(0.0)).when(band == 0, real - F.floor(real)).otherwise(real)
    return F.struct(F.coalesce(band, F.lit(0)).alias("c"), whole.alias("n"), part.alias("f"))


def value_key(kind, integer, real, text, blob):
    """Sort key of tagged values: null before numbers before texts before blobs; numbers compare exactly across integers and reals, NaN raises."""
    rank = F.when(kind == "null", 0).when(kind.isin("integer", "real"), 1).when(kind == "text", 2).when(kind == "blob", 3)
    sure = F.when(F.isnan(real), F.raise_error(F.lit("not a number")).cast("double")).otherwise(real)
    return F.struct(rank.alias("rank"), number_key(integer, sure).alias("number"), F.encode(text, "UTF-8").alias("text"), blob.alias("blob"))


def quote_literal(column, kind: str):
    """The value as an SQL literal."""
    if kind == "string":
        return F.when(column.isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(column, F.lit("'"), F.lit("''")), F.lit("'")))
    if kind == "binary":
        return F.when(column.isNull(), "NULL").otherwise(F.concat(F.lit("X'"), F.hex(column), F.lit("'")))
    return F.coalesce(column.cast("string"), F.lit("NULL"))


def substr(text, start, length=None):
    """Characters by SQL's older rules: a negative start counts from the end, place 0 stands before the first, a negative length takes what is before."""
    n = F.char_length(text)
    at = F.when(start < 0, n + start + 1).otherwise(start)
    end = F.lit(None).cast("int") if length is None else at + length
    low = F.greatest(at if length is None else F.least(at, end), F.lit(1))
    high = n + 1 if length is None else F.least(F.greatest(at, end), n + 1)
    return F.when(text.isNull() | start.isNull() | (F.lit(False) if length is None else length.isNull()), None).otherwise(F.substring(text, low, F.greatest(high - low, F.lit(0))))


def like_ascii(column, pattern):
    """LIKE that takes A-Z and a-z as equal and no other letters."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low(column).like(pattern.translate({k: k + 32 for k in range(65, 91)}))


def printf(pattern: str, *columns):
    """Formatted text; %s of null is empty, %d of null is 0."""
    import re

    kinds = re.findall(r"%[-+0 #]*\d*(?:\.\d+)?([a-zA-Z%])", pattern)
    filled = [F.coalesce(c, F.lit("")) if k == "s" else F.coalesce(c.cast("long"), F.lit(0).cast("long")) if k in "dxXo" else F.coalesce(c.cast("double"), F.lit(0.0)) for c, k in zip(columns, [k for k in kinds if k != "%"], strict=True)]
    return F.format_string(pattern, *filled)


def unhexed(text):
    """The bytes of a hexadecimal text; null if it is none."""
    return F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text))


def parse_hex(text, size: int):
    """The bytes of a hexadecimal text of ``size`` bytes; any other raises."""
    fits = text.rlike(f"^[0-9A-Fa-f]{{{2 * size}}}$")
    return F.when(fits, F.unhex(text)).when(text.isNotNull(), F.raise_error(F.lit(f"not {size} bytes in hexadecimal")).cast("binary"))


def zeroblob(n):
    """A blob of n zero bytes."""
    return F.unhex(F.repeat(F.lit("00"), F.greatest(n, F.lit(0)).cast("int")))


def blob_length(column):
    """Bytes of a blob."""
    return F.octet_length(column)


def julianday(ts):
    """Days since noon of 24 November 4714 BC, as a double."""
    return F.unix_micros(ts).cast("double") / F.lit(86400e6) + F.lit(2440587.5)


#: What each conversion of strftime is in a date pattern.
CONVERSIONS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%f": "ss.SSS"}


def strftime(pattern: str, ts):
    """A timestamp as text by strftime's conversions."""
    parts, k = [], 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two in CONVERSIONS:
            parts.append(F.date_format(ts, CONVERSIONS[two]))
        elif two == "%s":
            parts.append(F.unix_seconds(ts).cast("string"))
        elif two == "%w":
            parts.append((F.dayofweek(ts) - 1).cast("string"))
        elif two == "%J":
            parts.append(julianday(ts).cast("string"))
        elif two == "%%":
            parts.append(F.lit("%"))
        elif two[0] == "%":
            raise ValueError(f"no conversion {two}")
        else:
            parts.append(F.lit(pattern[k]))
            k -= 1
        k += 2
    return F.concat(*parts)


def datetime_shift(ts, *modifiers: str):
    """A timestamp after modifiers like '+3 days', '-1 month', 'start of month', 'start of year', 'start of day'."""
    import re

    for m in modifiers:
        if m.startswith("start of "):
            unit = m.removeprefix("start of ")
            if unit not in ("day", "month", "year"):
                raise ValueError(f"no modifier {m}")
            ts = F.date_trunc(unit, ts)
            continue
        found = re.fullmatch(r"([+-]?\d+) (second|minute|hour|day|month|year)s?", m)
        if not found:
            raise ValueError(f"no modifier {m}")
        ts = ts + F.expr(f"INTERVAL {int(found[1])} {found[2].upper()}")
    return ts


def vec_length(v):
    return F.size(v)


def vec_add(a, b):
    return F.zip_with(a, b, lambda x, y: x + y)


def vec_sub(a, b):
    return F.zip_with(a, b, lambda x, y: x - y)


def vec_normalize(v):
    """A vector of length 1 in the same direction."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(v, lambda x: x.cast("double") / norm)


def vec_to_json(v):
    return F.to_json(v)


def vec_version() -> str:
    return "1"


def cidr_allows(address, networks: list[str]):
    """Whether an IPv4 address lies in one of the networks (10.0.0.0/8, ...); a text that is no address lies in none. No networks allow all."""
    import ipaddress

    if not networks:
        return F.lit(True)
    part = lambda k: F.get(F.split(address, r"\."), k).cast("long")
    good = address.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}$") & ~address.endswith(".")
    number = F.when(good, part(0) * (1 << 24) + part(1) * (1 << 16) + part(2) * (1 << 8) + part(3))
    hit = F.lit(False)
    for text in networks:
        net = ipaddress.IPv4Network(text, strict=False)
        hit = hit | number.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(hit, F.lit(False))


def fits_long(number):
    """A whole number of any size as a 64-bit integer; one that does not fit raises."""
    exact = number.cast("decimal(38,0)")
    low, high = F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("9223372036854775807").cast("decimal(38,0)")
    return F.when(exact.between(low, high), exact.cast("long")).when(exact.isNotNull(), F.raise_error(F.lit("the number leaves 64 bits")).cast("long"))


def next_clock(clock: tuple[int, int, bytes], now: int) -> tuple[int, int, bytes]:
    """The hybrid logical clock's next version; called once per batch on the driver."""
    millis, logical, node = clock
    if now > millis:
        return now, 0, node
    return (millis + 1, 0, node) if logical >= 2**32 - 1 else (millis, logical + 1, node)
