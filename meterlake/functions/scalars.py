"""Column functions: rates, rounding, number text, dates and zones, schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000.0


def cost_usd(micros: Column | str) -> Column:
    return F.col(micros) / F.lit(MICROS) if isinstance(micros, str) else micros / F.lit(MICROS)


def cache_read_rate(total: Column, without: Column) -> Column:
    """max(0, total - without) / total; 0 without tokens. Never averaged: recompute from sums."""
    return F.when(total > 0, F.greatest(F.lit(0), total - without) / total).otherwise(F.lit(0.0))


def round_half_up(x: Column, digits: int = 4) -> Column:
    """Round half toward plus infinity on the binary value, unlike ``round``."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def percent_text(rate: Column) -> Column:
    """Whole percents; one decimal for rates between 0 and 1 %, from one product: 0.0055 is 0.6 %."""
    digits = F.when((rate > 0) & (rate < 0.01), 1).otherwise(0)
    value = F.when(digits == 1, F.floor(rate * 1000 + 0.5) / 10).otherwise(F.floor(rate * 100 + 0.5))
    return F.concat(F.when(digits == 1, F.format_number(value, 1)).otherwise(value.cast("bigint").cast("string")), F.lit("%"))


def js_number(x: Column) -> Column:
    """A double's text as JSON writes it elsewhere: ``1`` for 1.0, ``1e-7``, ``1e+21``."""
    text = x.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1)
    power = F.when(power == "", F.lit("0")).otherwise(power).cast("int")
    plain = F.regexp_replace(F.format_string("%s", x.cast("decimal(38,17)").cast("string")), r"\.?0+$", "")
    big = F.abs(x) >= 1e21
    small = (F.abs(x) < 1e-6) & (x != 0)
    sign = F.when(power > 0, F.lit("e+")).otherwise(F.lit("e"))
    digits = F.regexp_replace(mantissa, r"[-.]", "")
    tiny = F.concat(F.when(x < 0, "-").otherwise(""), F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.when(F.abs(x) < 1, tiny).otherwise(plain)
    return F.when(big | small, F.concat(mantissa, sign, power.cast("string"))).when(text.contains("E"), plain).otherwise(F.regexp_replace(text, r"\.0$", ""))


def total_tokens(explicit: Column, *parts: Column) -> Column:
    """The explicit total if positive, else the sum of the parts."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.when(explicit > 0, explicit).otherwise(total)


def json_number(doc: Column, *keys: str) -> Column:
    """First key that holds a JSON number; numbers in strings do not count."""
    found = []
    for key in keys:
        value = F.try_variant_get(doc, f"$.{key}", "variant")
        kind = F.schema_of_variant(value)
        found.append(F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(doc, f"$.{key}", "double")))
    return F.coalesce(*found) if len(found) > 1 else found[0]


def json_text(doc: Column, *keys: str) -> Column:
    """First key that holds a string with other characters than blanks."""
    found = []
    for key in keys:
        value = F.try_variant_get(doc, f"$.{key}", "variant")
        text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(doc, f"$.{key}", "string"))
        found.append(F.when(F.trim(text) != "", text))
    return F.coalesce(*found) if len(found) > 1 else found[0]


def report_date(text: Column) -> Column:
    """Date text of a report: ISO dates pass, instants fold to their UTC date, display dates are read as UTC."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    instant = F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd")
    shown = F.date_format(F.try_to_timestamp(text, F.lit("MMM d, yyyy")), "yyyy-MM-dd")
    return F.coalesce(iso, instant, shown, text)


def local_date(instant: Column, zone: Column) -> Column:
    """Calendar day of an instant (UTC timestamp) in a zone."""
    return F.date_format(F.from_utc_timestamp(instant, zone), "yyyy-MM-dd")


def local_time(instant: Column, zone: Column) -> Column:
    """Wall clock of an instant (UTC timestamp) in a zone, to the minute."""
    return F.date_format(F.from_utc_timestamp(instant, zone), "HH:mm")


def wall_to_utc(wall: Column, zone: Column, rounds: int = 3) -> Column:
    """UTC instant of a wall time, by fixed-point steps: in a gap or an overlap the result
    is where the steps lead, which ``to_utc_timestamp`` does not promise."""
    guess = wall
    for _ in range(rounds):
        seen = F.from_utc_timestamp(guess, zone)
        guess = F.timestamp_micros(F.unix_micros(guess) + F.unix_micros(wall) - F.unix_micros(seen))
    return guess


def schedule_list(text: Column) -> Column:
    """A list in text: split at blanks and commas, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.trim(text), r"[\s,]+"), lambda x: x != "")))


def weekday(day: Column) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(day) - 1


def next_run(now: Column, zone: Column, slots: Column, weekdays: Column) -> Column:
    """The least slot strictly after ``now`` within 8 local days; no slots mean 18:00, no weekdays every day."""
    today = F.to_date(F.from_utc_timestamp(now, zone))
    times = F.when(F.size(slots) > 0, slots).otherwise(F.array(F.lit("18:00")))
    days = F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.date_add(today, i)), lambda d: (F.size(weekdays) == 0) | F.array_contains(weekdays, weekday(d)))
    walls = F.flatten(F.transform(days, lambda d: F.transform(times, lambda t: wall_to_utc(F.to_timestamp(F.concat_ws(" ", d.cast("string"), t)), zone))))
    return F.array_min(F.filter(walls, lambda t: t > now))


def like_anywhere(column: Column, query: str) -> Column:
    """Case-folded (ASCII) containment in which % and _ of the query stay wildcards and a backslash is literal."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query)
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").like("%" + folded.replace("\\", "\\\\") + "%")


def csv_field(x: Column) -> Column:
    """Quoted if it holds a quote, comma or line break."""
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
