"""Text operators on string columns. Regular expressions are ASCII unless said; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of descriptions, of section names, and of section headings.
STOPWORDS = ["and", "the", "for", "with", "per", "to", "of", "in", "on", "by", "at", "or", "a", "an"]
ROOM_STOPWORDS = ["room", "area", "level", "floor", "story", "section", "zone", "main", "upper", "lower", "first", "second", "third", "the", "and", "of"]
TABLE_HEADER_WORDS = ["description", "qty", "quantity", "reset", "remove", "replace", "tax", "o&p", "total", "unit price", "price"]
NON_ROOM_WORDS = ["subtotal", "total", "estimate", "claim", "policy", "date", "page", "continued", "deductible", "overhead", "profit"]
NOISE = [
    "state farm", "statefarmfireclaims", "this estimate is priced", "terms, conditions and limits",
    "please contact your claim", "provided for reference only", "cannot authorize any contractor",
]
BANNED_HEADINGS = ["DESCRIPTION QTY RESET REMOVE REPLACE TAX O&P TOTAL", "DESCRIPTION QTY REMOVE REPLACE TAX O&P TOTAL", "DESCRIPTION QTY TAX O&P TOTAL"]
# Spellings of units.
UNITS = {
    "sq ft": "sf", "sqft": "sf", "sq. ft.": "sf", "sq. ft": "sf", "square foot": "sf", "square feet": "sf", "sq.ft.": "sf",
    "lin ft": "lf", "lin. ft": "lf", "lin. ft.": "lf", "linear foot": "lf", "linear feet": "lf", "lineal foot": "lf", "lineal feet": "lf",
    "each": "ea", "sq yd": "sy", "square yard": "sy", "square yards": "sy", "hour": "hr", "hours": "hr", "month": "mo", "week": "wk", "day": "day",
}
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c) -> Column:
    """Runs of white space to one space, none at the ends."""
    return strip(F.regexp_replace(_text(c), r"\s+", " "))


def lower_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9']+"), F.lit(0))


def profile_tokens(c) -> Column:
    """Distinct lower tokens of over two characters."""
    return F.array_distinct(F.filter(lower_tokens(c), lambda t: F.length(t) > 2))


def match_tokens(c) -> Column:
    return F.array_except(profile_tokens(c), F.array(*map(F.lit, STOPWORDS)))


def normalized_description(c) -> Column:
    body = F.regexp_replace(F.lower(_text(c)), r"^\s*\d+\s*[.)]\s*", "")  # white space at the ends is in no token
    return F.array_join(F.filter(F.regexp_extract_all(body, F.lit("[a-z0-9']+"), F.lit(0)), lambda t: ~t.isin(STOPWORDS)), " ")


def description_tokens(c) -> Column:
    """Distinct tokens of the normalised description; none for an empty one."""
    return F.filter(F.array_distinct(F.split(normalized_description(c), " ")), lambda t: t != "")


def room_tokens(c, stopwords: bool = True) -> Column:
    """Tokens of a section's name in order, with repeats; the matching stage keeps stop words."""
    tokens = F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(tokens, lambda t: ~t.isin(ROOM_STOPWORDS)) if stopwords else tokens


def room_numbers(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_text(c)), F.lit(r"\d+"), F.lit(0)))


def clean_description(c) -> Column:
    return F.regexp_replace(collapse(c), r"^[ \-:\t]+|[ \-:\t]+$", "")


def is_meaningful(c) -> Column:
    s = clean_description(c)
    long_tokens = F.size(F.filter(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9']+"), F.lit(0)), lambda t: F.length(t) > 2))
    return (F.length(s) >= 6) & (long_tokens >= 2) & (F.length(F.regexp_replace(s, r"[^\p{L}]", "")) >= 4)


def item_number(c) -> Column:
    """1 to 4 leading digits, a dot or bracket, and white space; else null."""
    return F.nullif(F.regexp_extract(_text(c), r"^\s*(\d{1,4})\s*[.)]\s+", 1), F.lit("")).cast("int")


def loose_item_number(c, default: int = 9999) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_text(c), r"^\s*(\d+)\s*[.)]\s*", 1), F.lit("")).cast("int"), F.lit(default))


def item_prefix(c) -> Column:
    n = F.regexp_extract(_text(c), r"^\s*(\d+)\s*[.)]\s*", 1)
    return F.when(n != "", F.concat(F.lit("[#"), n, F.lit("] "))).otherwise("")


def room_heading(c) -> Column:
    return F.regexp_replace(F.regexp_replace(collapse(c), r"(?i)^\s*continued\s*-\s*", ""), r"^[ \-:\t]+|[ \-:\t]+$", "")


def is_room_heading(c) -> Column:
    s = room_heading(c)
    words = "|".join(TABLE_HEADER_WORDS + NON_ROOM_WORDS)
    n = F.size(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9']+"), F.lit(0)))
    return (
        F.length(s).between(3, 72)
        & ~s.rlike(r"^\s*\d{1,4}\s*[.)]\s+")
        & ~s.rlike(rf"(?i)\b({words})\b")
        & ~s.contains("$")
        & n.between(1, 7)
        & (F.length(F.regexp_replace(s, r"[^\p{L}]", "")) >= 3)
        & (F.length(F.regexp_replace(s, r"[^0-9]", "")) <= 3)
    )


def section_total(c) -> Column:
    """The section that a totals line closes; null on other lines. There is no word border after "total"."""
    name = collapse(F.regexp_extract(_text(c), r"(?i)^\s*totals?\s*[:\-]?\s*([a-zA-Z].+)$", 1))
    name = strip(F.regexp_replace(name, r"\s+\d[\d\s,]*\.\d[\d\s,.]*$", ""))
    name = strip(F.regexp_replace(name, r"(?i)\s*-?\s*continued\s*$", ""))
    return F.nullif(name, F.lit(""))


def unit(c) -> Column:
    u = strip(F.lower(_text(c)))
    table = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.coalesce(F.element_at(table, u), u)


def spec_markers(c) -> Column:
    """Sorted fractions and numbers with a measure. Only "in" must end its word, so "2 gallons" gives 2ga."""
    s = F.replace(F.replace(F.lower(_text(c)), F.lit('"'), F.lit(" inch ")), F.lit("''"), F.lit(" inch "))
    for k, word in enumerate(NUMBER_WORDS, 1):
        s = F.regexp_replace(s, rf"\b{word}\b", str(k))
    number = rf"(?:\d|\b(?:{'|'.join(NUMBER_WORDS)})\b)"
    may_have = F.lower(_text(c)).rlike(rf"{number}\s*(?:[-–]\s*)?(?:coat|ply|gauge|ga|mil|in|\"|'')|{number}/{number}")  # most texts don't: a look saves the rest
    fractions = F.regexp_extract_all(s, F.lit(r"\b\d+/\d+\b"), F.lit(0))
    combos = F.regexp_extract_all(s, F.lit(r"\b(?:\d+(?:/\d+)?)\s*(?:[-–]\s*)?(?:coat|ply|gauge|ga|mil|inch|in\b)"), F.lit(0))
    found = F.array_sort(F.array_union(fractions, F.transform(combos, lambda m: F.regexp_replace(m, r"[\s\-–]", ""))))
    return F.when(may_have, found).otherwise(F.array().cast("array<string>"))


def nugget_signature(room: Column, description: Column, amount: Column) -> list[Column]:
    desc = collapse(F.regexp_replace(F.lower(_text(description)), r"^\s*\d+\.\s*", ""))
    return [strip(F.lower(_text(room))).alias("sig_room"), desc.alias("sig_desc"), F.round(amount, 2).alias("sig_amount")]


def item_signature(room: Column, description: Column, total: Column) -> list[Column]:
    desc = F.regexp_replace(strip(_text(description)), r"^\d+\.\s*", "")
    tokens = F.slice(F.filter(lower_tokens(desc), lambda t: F.length(t) > 2), 1, 9)
    return [F.array_join(F.slice(lower_tokens(room), 1, 4), " ").alias("sig_room"), F.array_join(tokens, " ").alias("sig_desc"), F.round(total, 2).alias("sig_amount")]


def cut(c, n: int) -> Column:
    s = strip(_text(c))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 3), F.lit("..."))).otherwise(s)


def money(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("$"), F.format_number(c, 2)))


def strict_amount(c) -> Column:
    """$ money; else comma and cents; else the last n.nn of a line with a unit code."""
    s = collapse(c)
    number = lambda pattern: F.replace(F.replace(F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")), F.lit("$"), F.lit("")), F.lit(","), F.lit("")).cast("double")
    cents = F.regexp_extract_all(s, F.lit(r"[0-9]+\.[0-9]{2}"), F.lit(0))
    last = F.when(s.rlike(r"\b(EA|HR|LF|SF|SY|SQ|DA)\b") & (F.size(cents) > 0), F.element_at(cents, -1).cast("double"))
    return F.coalesce(number(r"(\$[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?)"), number(r"([0-9]{1,3}(?:,[0-9]{3})+\.[0-9]{2})"), last)


def is_noise(c) -> Column:
    low = F.lower(_text(c))
    out = (low.startswith("date:") & low.contains("page:")) | _text(c).rlike(r"^\d{1,3}$")
    for s in NOISE:
        out = out | low.contains(s)
    return out


def is_room_line(c) -> Column:
    s = _text(c)
    shape = s.rlike(r"^[A-Z][a-z]+(?:[ /&\-][A-Z][a-z]+){0,6}$") | s.rlike(r"^[A-Z][A-Z0-9 /&\-]{2,}$")
    return (s != "") & ~s.isin(BANNED_HEADINGS) & (F.length(s) <= 45) & ~s.rlike(r"^\d+$") & shape


def chunks(c, size: int) -> Column:
    """Lines, stripped and not blank, packed greedily into chunks of at most size characters with their line ends."""
    lines = F.filter(F.transform(F.split(_text(c), "\n"), strip), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc: Column, line: Column) -> Column:
        fits = (acc["now"] == "") | (F.length(acc["now"]) + F.length(line) + 1 <= size)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"),
            F.when(acc["now"] == "", line).when(fits, F.concat(acc["now"], F.lit("\n"), line)).otherwise(line).alias("now"),
        )

    return F.aggregate(lines, start, add, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once a row: a lambda's variable is bound, where a column would be put in again
    wherever it stands, and for each element inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def locator_candidates(c) -> Column:
    """Phrases to find an item by, most telling first, four characters at least, each spelling once but for case."""
    first = lambda w, k: F.array_join(F.slice(w, 1, k), " ")

    def phrases(raw: Column) -> Column:
        number, rest = F.regexp_extract(raw, r"^(\d+)\.\s*(.+)", 1), strip(F.regexp_extract(raw, r"^(\d+)\.\s*(.+)", 2))
        numbered = lambda x: F.array(F.when(x["n"] != "", F.concat(x["n"], F.lit(". "), first(x["w"], 2))), F.when((x["n"] != "") & (F.size(x["w"]) >= 4), F.concat(x["n"], F.lit(". "), first(x["w"], 4))))
        told = _once(F.struct(number.alias("n"), F.split(rest, " ").alias("w")), numbered)
        return F.concat(told, F.array(raw), _once(F.regexp_replace(raw, r"^\d+\.\s*", ""), lambda bare: F.concat(F.array(bare), _once(shorter(bare), lambda x: F.concat(F.array(x), _once(F.split(x, " "), lambda w: F.array(*(first(w, k) for k in (8, 6, 4)))))))))

    def shorter(bare: Column) -> Column:
        compact = F.regexp_replace(F.regexp_replace(bare, r"(?i)\b\d+(?:\.\d+)?\s*(?:EA|LF|SF|SQ|SY|HR|MO|WK|DAY)\b", ""), r"\$?\d[\d,]*(?:\.\d{2})?", "")
        return F.regexp_replace(collapse(compact), r"^[ \-:]+|[ \-:]+$", "")

    clean = lambda x: F.filter(F.transform(F.filter(x, lambda y: y.isNotNull()), collapse), lambda y: F.length(y) >= 4)
    alike = lambda found: _once(F.transform(found, F.lower), lambda lows: F.filter(found, lambda x, k: F.array_position(lows, F.lower(x)) == k + 1))
    return _once(_once(collapse(c), lambda raw: clean(phrases(raw))), alike)
