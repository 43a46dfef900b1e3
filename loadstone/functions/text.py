"""Labels, relative time, hashes, record encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FUELS = {"SUN": "solar", "WND": "wind", "NG": "gas", "NUC": "nuclear", "COL": "coal", "WAT": "hydro", "OTH": "other"}
DRIFT_KEYS = {"ts": "ts", "predicted": "p", "actual": "a", "abs_pct_error": "e", "smape": "s", "lead_hours": "l", "anchor_ts": "at", "placeholder": "ap", "conditioned": "ac"}
DRIFT_DIGITS = {"predicted": 2, "actual": 2, "abs_pct_error": 4, "smape": 4}
DRIFT_SCHEMA = "ts TIMESTAMP, p DOUBLE, a DOUBLE, e DOUBLE, s DOUBLE, l BIGINT, at TIMESTAMP, ap BOOLEAN, ac BOOLEAN"
VINTAGE_KEYS = {"target_ts": "ts", "first_seen_d": "d", "captured_at": "at", "last_d": "ld", "n_updates": "n", "first_seen_df": "df", "df_at": "dfat"}
VINTAGE_DIGITS = {"first_seen_d": 2, "last_d": 2, "first_seen_df": 2}
VINTAGE_SCHEMA = "ts TIMESTAMP, d DOUBLE, at TIMESTAMP, ld DOUBLE, n BIGINT, df DOUBLE, dfat TIMESTAMP"


def fuel_name(code: str) -> Column:
    """Known codes by name, others in lower case."""
    known = F.create_map(*[F.lit(x) for kv in FUELS.items() for x in kv])
    return F.coalesce(known[F.col(code)], F.lower(code))


def feature_label(name: Column, labels: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(known[name], _title(F.replace(name, F.lit("_"), F.lit(" "))))


def _title(text: Column) -> Column:
    """Letters after anything but a letter in upper case, the others in lower case."""
    chars = F.split(text, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(F.coalesce(F.get(chars, i - 1).rlike("\\p{L}"), F.lit(False)), F.lower(c)).otherwise(F.upper(c))), "")


def thousands(v: Column, unit: str = "MW") -> Column:
    return F.concat(F.format_number(v, 0), F.lit(f" {unit}"))


def driver_line(label: Column, v: Column) -> Column:
    return F.concat(label, F.lit(": "), F.when(v >= 0, "+").otherwise(""), thousands(v))


def relative_time(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    return (
        F.when(s < 60, "just now").when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).when(h < 24, F.concat(h.cast("string"), F.lit("h ago")))
        .when(d == 1, "yesterday").when(d > 1, F.concat(d.cast("string"), F.lit("d ago"))).otherwise(""))


def pct_change(old: Column, new: Column) -> Column:
    return (new - old) / F.abs(F.nullif(old, F.lit(0))) * 100


def stable_seed(text: Column) -> Column:
    """First four bytes of the SHA-256 as an unsigned integer."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def feature_hash(names: Sequence[str]) -> Column:
    """Digest of the sorted feature list, sixteen hex digits."""
    return F.substring(F.sha2(F.lit(",".join(sorted(names))), 256), 1, 16)


def row_signature(*cols: str) -> Column:
    """Row digest with numbers at six decimals; null is its own token."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in cols]), 256)


def frame_signature(*cols: str) -> Column:
    """Order-free aggregate digest: xor and sum of 40-bit row hashes, and the count.

    Columns are joined as text, so numbers should be whole or already formatted.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in cols])), 1, 10), 16, 10).cast("long")
    return F.concat_ws("-", F.bit_xor(h).cast("string"), F.sum(h).cast("string"), F.count("*").cast("string"))


def predictions_hash(predictions: Column) -> Column:
    return F.md5(F.array_join(F.transform(predictions, lambda p: F.format_string("%.2f", p)), ","))


def encode_record(keys: dict[str, str] = DRIFT_KEYS, digits: dict[str, int] = DRIFT_DIGITS) -> Column:
    """JSON with short keys and rounded numbers; null and non-finite fields are left out."""
    def value(c: str) -> Column:
        if c not in digits:
            return F.col(c)
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, digits[c]))

    return F.to_json(F.struct(*[value(c).alias(k) for c, k in keys.items()]))


def decode_record(doc: str, schema: str = DRIFT_SCHEMA, keys: dict[str, str] = DRIFT_KEYS) -> list[Column]:
    """The fields of a record, null where absent; an absent symmetric error follows from the two values."""
    r = F.from_json(doc, schema)
    fields = {c: r[k] for c, k in keys.items()}
    if "smape" in fields:
        p, a = fields["predicted"], fields["actual"]
        fields["smape"] = F.coalesce(fields["smape"], F.try_divide(200 * F.abs(a - p), F.abs(a) + F.abs(p)))
    return [v.alias(c) for c, v in fields.items()]
