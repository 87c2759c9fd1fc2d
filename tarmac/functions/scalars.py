"""Scalar column functions."""

from __future__ import annotations

import base64
import json
import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# The check digit's weights, and all characters at places whose last digit is their value.
VIN_VALUES = "0123456789.ABCDEFGH..JKLMN.P.R..STUVWXYZ"
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
VIN_SHAPE = "^[A-HJ-NPR-Z0-9]{17}$"


def ratio(num: Column, den: Column) -> Column:
    """num / den; null where den is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def std_from_sums(total: Column, squares: Column, n: Column) -> Column:
    """Population standard deviation from running sums, never below 0; null without values."""
    mean = ratio(total, n)
    return F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), ratio(squares, n) - mean * mean)))


def f32(x: Column) -> Column:
    """The value as it is after storage in single precision."""
    return x.cast("float").cast("double")


def py_round(x: Column, digits: int) -> Column:
    """Rounds the exact binary value to a few decimals, ties to even, as Python does: 2.675 becomes 2.67.

    The high and the low half of the value times the power of ten are exact, so is their distance from the middle between
    two neighbours.
    """
    m, high = F.lit(float(10**digits)), x.cast("float").cast("double")
    below = F.floor(x * m).cast("double")
    over = (high * m - (below + F.lit(0.5))) + (x - high) * m
    up = (over > 0) | ((over == 0) & (F.pmod(below, F.lit(2.0)) == 1))
    return F.when(F.abs(x * m) < 1e12, (below + F.when(up, 1.0).otherwise(0.0)) / m).otherwise(x)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def vin_check_digit(vin: Column) -> Column:
    """The ninth character that the others of a VIN ask for. Plain arithmetic, no lambda functions: Spark compiles it."""
    value = lambda i: F.instr(F.lit(VIN_VALUES), F.substring(vin, i + 1, 1)) - 1
    total = reduce(add, [value(i) % 10 * w for i, w in enumerate(VIN_WEIGHTS) if w])
    return F.substr(F.lit("0123456789X"), F.pmod(total, F.lit(11)) + 1, F.lit(1))


def is_valid_vin(vin: Column) -> Column:
    """17 characters without I, O and Q, whose ninth is the check digit; false for null."""
    return F.coalesce(vin.rlike(VIN_SHAPE), F.lit(False)) & (F.substring(vin, 9, 1) == vin_check_digit(vin))


def vin_of_payload(payload: Column) -> Column:
    """The VIN of a JSON payload in either layout."""
    return F.coalesce(F.get_json_object(payload, "$.vin"), F.get_json_object(payload, "$.vehicle.vin"))


def hash_percent(text: Column, modulus: int = 100) -> Column:
    """SHA-256 of a text as one big number, modulo ``modulus``."""
    digits = F.transform(F.split(F.sha2(text, 256), ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda acc, d: (acc * 16 + d) % modulus)


def uuid5(namespace: uuid.UUID | str, name: Column) -> Column:
    """The name-based UUID of version 5, lower-case."""
    space = F.unhex(F.lit(uuid.UUID(str(namespace)).hex))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp (one without a zone counts as UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def parse_ts_ms(text: Column) -> Column:
    """Epoch milliseconds of a text: ISO 8601 (without an offset: UTC), or digits that are milliseconds already."""
    return F.when(text.rlike(r"^[0-9]{11,}$"), text.try_cast("long")).otherwise(F.unix_millis(F.try_to_timestamp(text)))


def iso_millis(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_centis(ms: Column) -> Column:
    """ISO 8601 with hundredths of a second (cut, not rounded)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SS'Z'")


def latency_ms(ingested_ms: Column, now_ms: Column | None = None) -> Column:
    """How long ago something was ingested, never below 0; ``now_ms`` is the current time unless given."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    return F.greatest(F.lit(0).cast("long"), now - ingested_ms)


def percent_label(p: Column) -> Column:
    """A probability for display."""
    return F.when(p.isNull(), "n/a").when(p >= 0.999, ">99.9%").otherwise(F.format_string("%.1f%%", 100 * p))


def money_label(x: Column) -> Column:
    """An amount in dollars for display; unknown (null or negative) ones say what is missing."""
    return F.when(x.isNull() | (x < 0), "cost data required").otherwise(F.concat(F.lit("$"), F.format_number(x, 0)))


def sorted_codes(codes: Column, more: Column | None = None) -> Column:
    """The distinct codes of an array, and of a second one, in order; null counts as empty."""
    empty = F.array().cast("array<string>")
    own = F.coalesce(codes, empty)
    return F.array_sort(F.array_distinct(own) if more is None else F.array_union(own, F.coalesce(more, empty)))


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def coarse(x: Column, digits: int = 2) -> Column:
    """A coordinate as roles without full access see it."""
    return F.round(x, digits)


def any_code_of(codes: Column, registry: dict[str, str], component: str) -> Column:
    """Whether any code of an array belongs to the component."""
    wanted = [c for c, x in registry.items() if x == component]
    return F.coalesce(F.arrays_overlap(codes, F.array(*[F.lit(c) for c in wanted])), F.lit(False)) if wanted else F.lit(False)


def percent_text(component: Column, p: Column) -> Column:
    return F.concat(component, F.format_string(": %.0f%% probability of maintenance or failure within 7 days", p * 100))


def encode_cursor(values: dict) -> str:
    """An opaque text for a page's last sort key."""
    return base64.urlsafe_b64encode(json.dumps(values, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str, keys: list[str]) -> dict:
    """The sort key of a cursor; ValueError if it isn't one of ours."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except Exception as e:
        raise ValueError("malformed cursor") from e
    if not isinstance(found, dict) or set(found) != set(keys):
        raise ValueError("malformed cursor")
    return found
