"""Text that people read: amounts, shares, messages, cards; masking and sealing.

All are column functions, so that whole tables are rendered where their rows are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake.functions.scalars import percent_text

# Where compact numbers begin, their units, and the magnitudes of Chinese numerals.
COMPACT = 1_000_000
UNITS = ((1e15, "P"), (1e12, "T"), (1e9, "B"), (1e6, "M"))
MAGNITUDES = ((1e16, "京"), (1e12, "万亿"), (1e8, "亿"), (1e4, "万"))
# Metrics of a card, its default order, its slots by layout, and how many may be chosen.
METRICS = ("totalTokens", "totalCost", "monthTokens", "monthCost", "todayTokens", "todayCost")
DEFAULT_METRICS = METRICS[:4]
SLOTS = {"compact": 6, "balanced": 4, "wide": 3}
CHOSEN = 6
# Bytes of a message at most, and entries of its lists.
MESSAGE_BYTES, LISTED = 4096, 3


def integer_text(x: Column) -> Column:
    return F.format_number(x, 0)


def decimal_text(x: Column, grouped: bool = True) -> Column:
    """Two decimals at most, without trailing zeros."""
    text = F.regexp_replace(F.format_number(F.round(x, 2), 2), r"\.?0+$", "")
    return text if grouped else F.regexp_replace(text, ",", "")


def usd_text(x: Column) -> Column:
    amount = F.concat(F.lit("$"), F.format_number(F.round(F.abs(x), 2), 2))
    return F.when(F.round(x, 2) < 0, F.concat(F.lit("-"), amount)).otherwise(amount)


def compact_text(x: Column) -> Column:
    """A number of a million or more in its unit; one that rounds to a thousand takes the next."""
    size = F.abs(x).cast("double")
    found = F.concat(decimal_text(size / UNITS[-1][0]), F.lit(UNITS[-1][1]))
    for (unit, suffix), (below, _) in reversed(list(zip(UNITS[:-1], UNITS[1:]))):
        reached = (size >= unit) | (F.floor(size / below * 100 + 0.5) / 100 >= 1000)
        found = F.when(reached, F.concat(decimal_text(size / unit), F.lit(suffix))).otherwise(found)
    return F.concat(F.when(x < 0, "-").otherwise(""), found)


def magnitude_text(x: Column) -> Column:
    size = F.abs(x).cast("double")
    found = F.format_number(size, 0)
    for unit, name in reversed(MAGNITUDES):
        found = F.when(size >= unit, F.concat(decimal_text(size / unit, grouped=False), F.lit(name))).otherwise(found)
    return F.concat(F.when(x < 0, "-").otherwise(""), found)


def metric_text(x: Column) -> Column:
    """``value``, ``exact`` and, for large numbers, ``detail``."""
    exact, large = integer_text(x), F.abs(x) >= COMPACT
    return F.struct(F.when(large, compact_text(x)).otherwise(exact).alias("value"), exact.alias("exact"), F.when(large, magnitude_text(x)).alias("detail"))


def usd_metric_text(x: Column) -> Column:
    exact, large = usd_text(x), F.abs(x) >= COMPACT
    short = F.concat(F.when(x < 0, "-$").otherwise("$"), compact_text(F.abs(x)))
    return F.struct(F.when(large, short).otherwise(exact).alias("value"), exact.alias("exact"), F.when(large, F.concat(magnitude_text(x), F.lit(" USD"))).alias("detail"))


def share_text(value: Column, total: Column) -> Column:
    """Whole percents of a total; none of nothing."""
    return F.when(total > 0, F.concat(F.floor(value / total * 100 + 0.5).cast("string"), F.lit("%"))).otherwise("0%")


def trend_height(value: Column, most: Column) -> Column:
    """Height of a trend's bar in percent; 2 for nothing, 8 at least."""
    return F.when((most <= 0) | (value <= 0), 2).otherwise(F.greatest(F.lit(8), F.floor(value / most * 100 + 0.5)))


def bar_height(value: Column, total: Column) -> Column:
    """Width of a share's bar in percent; 0 for nothing, 8 at least, 100 at most."""
    return F.when((total <= 0) | (value <= 0), 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(8), F.floor(value / total * 100 + 0.5))))


def chosen_metrics(names: Column) -> Column:
    """The metrics a card shows: the first six of a list, each once; the default for a null list or an unknown name."""
    default = F.array(*map(F.lit, DEFAULT_METRICS))
    known = F.forall(names, lambda x: x.isin(*METRICS))
    return F.when(F.coalesce(known, F.lit(False)), F.array_distinct(F.slice(names, 1, CHOSEN))).otherwise(default)


def slot_count(layout: Column) -> Column:
    found = F.lit(SLOTS["balanced"])
    for name, n in SLOTS.items():
        found = F.when(layout == name, n).otherwise(found)
    return found


def xml_escape(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def card(title: Column, metrics: Column, values: Column, layout: Column) -> Column:
    """A card as SVG: the title, and the chosen metrics' names and values in the layout's slots.

    ``values``: a map from metric to text."""
    shown = F.slice(metrics, F.lit(1), slot_count(layout))
    across = F.when(layout == "compact", 3).otherwise(2)

    def block(name: Column, i: Column) -> Column:
        x, y = 24 + (i % across) * F.floor(F.lit(480) / across), 96 + F.floor(i / across) * 56
        parts = [F.lit('<text x="'), x.cast("string"), F.lit('" y="'), y.cast("string"), F.lit('">'), xml_escape(name), F.lit(": "), xml_escape(F.coalesce(F.element_at(values, name), F.lit("0"))), F.lit("</text>")]
        return F.concat(*parts)

    body = F.array_join(F.transform(shown, block), "")
    return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="520" height="220"><title>'), xml_escape(title), F.lit("</title>"), body, F.lit("</svg>"))


def message_escape(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return F.regexp_replace(text, "\r?\n", " ")


def truncated(text: Column, most: int, suffix: str) -> Column:
    """A text of ``most`` bytes in UTF-8 at most; a longer one is cut between characters and ends in ``suffix``."""
    raw, room = F.encode(text, "UTF-8"), max(0, most - len(suffix.encode()))
    inner = lambda k: F.conv(F.hex(F.substring(raw, k + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) == 0x80
    cut = F.lit(max(room - 3, 0))
    for k in range(max(room - 2, 0), room + 1):
        cut = F.when(~inner(k), k).otherwise(cut)
    kept = F.decode(F.substring(raw, F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(kept, r"\s+$", ""), F.lit(suffix)))


@dataclass(frozen=True)
class Wording:
    """The words of a report's message."""

    title: str = "daily usage"
    tokens: str = "Tokens"
    net: str = "without cache reads"
    rate: str = "Cache rate"
    cost: str = "Cost"
    sessions: str = "Sessions"
    sources: str = "Sources"
    models: str = "Models"
    nothing: str = "no data"
    hidden: str = "more"
    link: str = "Open report"
    cut: str = "\n\n..."


SOURCE_NAMES = {"claude-code": "Claude Code", "codex": "Codex"}


def source_name(source: Column) -> Column:
    found = source
    for key, name in SOURCE_NAMES.items():
        found = F.when(source == key, name).otherwise(found)
    return found


def report_message(words: Wording = Wording(), most: int = MESSAGE_BYTES, count_text=integer_text) -> Column:
    """The message of a report's row: ``display_name``, ``report_date``, ``timezone``, ``total_tokens``,
    ``tokens_without_cache_read``, ``cache_rate``, ``cost_usd``, ``session_count``, ``url`` and the lists
    ``sources`` and ``models`` (structs of ``name``, ``tokens``, ``net``, ``rate``, ``cost``), largest first.
    ``count_text`` writes the number of sessions."""

    def entries(items: Column, named) -> Column:
        line = lambda x: F.concat(F.lit("- "), message_escape(named(x["name"])), F.lit(": "), integer_text(x["net"]), F.lit(f" ({words.tokens.lower()} "), integer_text(x["tokens"]), F.lit(", "), percent_text(x["rate"]), F.lit(", "), usd_text(x["cost"]), F.lit(")"))
        shown = F.array_join(F.transform(F.slice(items, 1, LISTED), line), "\n")
        more = F.size(items) - LISTED
        return F.when(F.size(items) == 0, words.nothing).when(more > 0, F.concat(shown, F.lit("\n- "), more.cast("string"), F.lit(f" {words.hidden}"))).otherwise(shown)

    lines = [
        F.concat(F.lit("## "), message_escape(F.col("display_name")), F.lit(f" {words.title}")),
        F.concat(message_escape(F.col("report_date")), F.lit(" / "), message_escape(F.col("timezone"))), F.lit(""),
        F.concat(F.lit(f"{words.tokens}: "), integer_text(F.col("total_tokens")), F.lit(", "), integer_text(F.col("tokens_without_cache_read")), F.lit(f" {words.net}")),
        F.concat(F.lit(f"{words.rate}: "), percent_text(F.col("cache_rate")), F.lit(f", {words.cost}: "), usd_text(F.col("cost_usd")), F.lit(f", {words.sessions}: "), count_text(F.col("session_count"))), F.lit(""),
        F.lit(f"**{words.sources}**"), entries(F.col("sources"), source_name), F.lit(""), F.lit(f"**{words.models}**"), entries(F.col("models"), lambda x: x), F.lit(""),
        F.concat(F.lit(f"[{words.link}]("), F.col("url"), F.lit(")")),
    ]
    return truncated(F.concat_ws("\n", *lines), most, words.cut)


def masked_url(url: Column) -> Column:
    """Only the host of an address that holds a secret."""
    return F.concat(F.parse_url(url, F.lit("HOST")), F.lit("/..."))


def redacted_error(text: Column, most: int = 500) -> Column:
    """An error's text without the secrets of addresses in it."""
    text = F.regexp_replace(text, r"""(?i)([?&](?:key|access_token|sign)=)[^&#\s"'<>]+""", "$1[redacted]")
    text = F.regexp_replace(text, r"""(?i)(/open-apis/bot/v2/hook/)[^/?#\s"'<>]+""", "$1[redacted]")
    return F.left(text, F.lit(most))


def sealed(text: Column, key: Column, nonce: Column) -> Column:
    """AES-GCM of a text under a 16, 24 or 32 byte key and a 12 byte nonce, in base64."""
    return F.base64(F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"), nonce))


def opened(text: Column, key: Column) -> Column:
    """The text of :func:`sealed`; null if it was altered or the key is another."""
    return F.try_aes_decrypt(F.unbase64(text), key, F.lit("GCM")).cast("string")


def signature(message: Column, secret: Column) -> Column:
    """HMAC-SHA-256 in base64, by its definition from the hash function."""
    block = 64
    raw = F.encode(secret, "UTF-8")
    key = F.when(F.length(raw) > block, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    padded = F.rpad(F.hex(key), 2 * block, "0")
    flip = lambda pad: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.lpad(F.conv(F.conv(F.substring(padded, 2 * i + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(pad)).cast("string"), 10, 16), 2, "0")), ""))
    inner = F.unhex(F.sha2(F.concat(flip(0x36), F.encode(message, "UTF-8")), 256))
    return F.base64(F.unhex(F.sha2(F.concat(flip(0x5C), inner), 256)))
