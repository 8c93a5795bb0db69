"""Names, house numbers, places written as text, links, opening hours and route keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

lit = F.lit
MODES = ("starts", "word_starts", "later_word_starts", "word_equals", "contains", "equals", "query_holds_word")


def _spaced(c: Column) -> Column:
    """What is neither a letter nor a digit as a space."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", " ")


def _has(a: Column, b: Column) -> Column:
    return F.contains(F.collate(a, "UNICODE_CI_AI"), F.collate(b, "UNICODE_CI_AI"))


def matches(name: Column, query: str, mode: str) -> Column:
    """Whether a name matches a query in a mode, whatever the case and the accents; null names do not.

    A dot at the end of the query tells that it is cut: whole-word modes then ask for the beginning alone.
    A name with hyphens is tried without them, too. An empty query matches.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if query.endswith(".") and query.strip("."):
        query, mode = query[:-1], {"word_equals": "word_starts", "equals": "starts"}.get(mode, mode)
    q = lit(query)
    edge = F.concat(lit(" "), _spaced(q))

    def one(n: Column) -> Column:
        words = F.concat(lit(" "), _spaced(n))
        same = F.collate(n, "UNICODE_CI_AI") == F.collate(q, "UNICODE_CI_AI")
        return {
            "starts": lambda: F.startswith(F.collate(n, "UNICODE_CI_AI"), F.collate(q, "UNICODE_CI_AI")),
            "word_starts": lambda: _has(words, edge), "later_word_starts": lambda: _has(_spaced(n), edge),
            "word_equals": lambda: _has(F.concat(words, lit(" ")), F.concat(edge, lit(" "))), "contains": lambda: _has(n, q), "equals": lambda: same,
            "query_holds_word": lambda: _has(F.concat(edge, lit(" ")), F.concat(words, lit(" "))),
        }[mode]()

    if not query:
        return name.isNotNull()
    return F.coalesce(one(name) | (name.contains("-") & one(F.replace(name, lit("-"), lit("")))), lit(False))


def house_number_parts(name: Column) -> Column:
    """Runs of digits and runs of letters, lower case, distinct and sorted: 18B, 18-b and 18 B are alike; the name itself without any."""
    low = F.lower(name)
    parts = F.array_sort(F.array_distinct(F.regexp_extract_all(low, lit(r"(\p{Nd}+|\p{L}+)"), 1)))
    return F.when(F.size(parts) > 0, parts).when(name.isNotNull(), F.array(low))


def route_keys(tags: Column) -> Column:
    """array<struct<type, n, tags>> from tags `route_<type>_<n>_<key>`: one for each n from 1 to the largest that is a tag of its own."""
    entries = F.map_entries(tags)
    part = lambda k, p, i: F.regexp_extract(k, p, i)
    own, keyed = r"^route_([a-z]+)_([0-9]+)$", r"^route_([a-z]+)_([0-9]+)_(.+)$"
    heads = F.transform(F.filter(entries, lambda e: e["key"].rlike(own)), lambda e: F.struct(part(e["key"], own, 1).alias("type"), part(e["key"], own, 2).cast("int").alias("n")))
    types = F.array_sort(F.array_distinct(F.transform(heads, lambda h: h["type"])))

    def of(kind: Column, n: Column) -> Column:
        mine = F.filter(entries, lambda e: (part(e["key"], keyed, 1) == kind) & (part(e["key"], keyed, 2).cast("int") == n))
        return F.struct(kind.alias("type"), n.alias("n"), F.map_from_entries(F.transform(mine, lambda e: F.struct(part(e["key"], keyed, 3), e["value"]))).alias("tags"))

    def every(kind: Column) -> Column:
        most = F.array_max(F.transform(F.filter(heads, lambda h: h["type"] == kind), lambda h: h["n"]))
        return F.when(most > 0, F.transform(F.sequence(lit(1), most), lambda n: of(kind, n)))

    return F.flatten(F.filter(F.transform(types, every), lambda a: a.isNotNull()))


def place(text: Column) -> Column:
    """struct<lat, lon> of a place as text: degrees, degrees and minutes, or also seconds, each half alike; null for other text.

    Signs or N, S, E, W tell the side; E or W first means longitude first. A decimal comma is read as a point where no point is.
    """
    comma = ~text.contains(".") & text.rlike(r"\d,\d")
    t = F.when(comma, F.regexp_replace(text, r"(\d),(\d)", "$1.$2")).otherwise(text)

    def found(w: Column) -> Column:
        numbers = F.regexp_extract_all(w["t"], lit(r"(-?\d+(?:\.\d+)?)"), 1)
        sides = F.regexp_extract_all(F.upper(w["t"]), lit(r"([NSEW])"), 1)
        plain = ~F.regexp_replace(F.upper(w["t"]), "[NSEW]", "").rlike(r"\p{L}")
        return F.struct(F.when(plain, numbers).alias("numbers"), sides.alias("sides"), F.floor(F.size(numbers) / 2).cast("int").alias("each"))

    def half(w: Column, first: Column, side: int) -> Column:
        part = lambda i: F.when(lit(i) < w["each"], F.get(w["numbers"], first + i).cast("double"))
        size = F.abs(part(0)) + F.coalesce(part(1), lit(0.0)) / lit(60.0) + F.coalesce(part(2), lit(0.0)) / lit(3600.0)
        minus = F.get(w["numbers"], first).startswith("-") != F.coalesce(F.get(w["sides"], lit(side)).isin("S", "W"), lit(False))
        return F.when(minus, -size).otherwise(size)

    def halves(w: Column) -> Column:
        return F.struct(half(w, lit(0), 0).alias("a"), half(w, w["each"], 1).alias("b"), F.coalesce(F.get(w["sides"], lit(0)).isin("E", "W"), lit(False)).alias("swapped"))

    def checked(w: Column) -> Column:
        lat, lon = F.when(w["swapped"], w["b"]).otherwise(w["a"]), F.when(w["swapped"], w["a"]).otherwise(w["b"])
        return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))

    # Each step is bound once, as an array of one, so that the next does not repeat its expression.
    steps = F.transform(F.array(F.struct(t.alias("t"))), found)
    steps = F.filter(steps, lambda w: F.size(w["numbers"]).isin(2, 4, 6) & F.size(w["sides"]).isin(0, 2))
    return F.get(F.transform(F.transform(steps, halves), checked), lit(0))


NUMBER = r"(-?\d+(?:\.\d+)?)"
# How links of map sites name a place; the order of latitude, longitude and zoom in each.
LINKS = (
    (rf"^geo:{NUMBER},{NUMBER}(?:.*[?&]z={NUMBER})?", (1, 2, 3)), (rf"@{NUMBER},{NUMBER},{NUMBER}z", (1, 2, 3)), (rf"#map={NUMBER}/{NUMBER}/{NUMBER}", (2, 3, 1)),
    (rf"[?&]mlat={NUMBER}&mlon={NUMBER}(?:&zoom={NUMBER})?", (1, 2, 3)), (rf"yandex\..*[?&]ll={NUMBER}(?:,|%2C){NUMBER}(?:.*[?&]z={NUMBER})?", (2, 1, 3)),
    (rf"[?&](?:ll|q|sll|query|center)={NUMBER}(?:,|%2C){NUMBER}(?:.*[?&]z={NUMBER})?", (1, 2, 3)), (rf"here\.com/.*[/=]{NUMBER},{NUMBER},{NUMBER}", (1, 2, 3)),
)


def link_target(link: Column) -> Column:
    """struct<lat, lon, zoom> of a geo address or a map site's link, zoom 0 where it has none; null for others."""
    forms = []
    for pattern, order in LINKS:
        lat, lon, zoom = (F.nullif(F.regexp_extract(link, pattern, i), lit("")).cast("double") for i in order)
        forms.append(F.when(link.rlike(pattern), F.struct(lat.alias("lat"), lon.alias("lon"), F.coalesce(zoom, lit(0.0)).alias("zoom"))))
    return F.coalesce(*forms)


# The days of opening hours, from Monday.
DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
SPAN = r"\d{1,2}:\d{2}-\d{1,2}:\d{2}"
RULE = rf"^(?:((?:[A-Z][a-z](?:-[A-Z][a-z])?,?)+) +)?(off|closed|{SPAN}(?:, *{SPAN})*)$"


def is_open(hours: Column, day: Column, minute: Column) -> Column:
    """Whether a place is open on a day (0 is Monday) at a minute of it; null where the hours do not parse.

    Rules `days times`, parted by `;`: of those for a day the last one counts. Times past midnight reach into the next day.
    `24/7` is always open. Public holidays, months and weeks are not understood.
    """
    rules = F.filter(F.transform(F.split(hours, ";"), lambda t: F.trim(t)), lambda r: r != "")
    number = lambda d: F.array_position(F.array(*map(lit, DAYS)), d) - 1
    minutes = lambda t: F.regexp_extract(t, r"(\d+):", 1).cast("int") * 60 + F.regexp_extract(t, r":(\d+)", 1).cast("int")

    def on(rule: Column, of: Column) -> Column:
        days = F.regexp_extract(rule, RULE, 1)

        def named(part: Column) -> Column:
            a, b = number(F.get(F.split(part, "-"), lit(0))), number(F.element_at(F.split(part, "-"), -1))
            return F.when(a <= b, of.between(a, b)).otherwise((of >= a) | (of <= b))

        return (days == "") | F.exists(F.split(days, ","), named)

    def times(of: Column) -> Column:
        last = F.element_at(F.filter(rules, lambda r: on(r, of)), -1)
        return F.when(F.size(F.filter(rules, lambda r: on(r, of))) > 0, F.regexp_extract_all(last, lit(f"({SPAN})"), 1))

    def ends(span: Column) -> tuple[Column, Column]:
        return minutes(F.get(F.split(span, "-"), lit(0))), minutes(F.get(F.split(span, "-"), lit(1)))

    def today(span: Column) -> Column:
        a, b = ends(span)
        return (minute >= a) & ((minute < b) | (b <= a))

    def yesterday(span: Column) -> Column:
        a, b = ends(span)
        return (b <= a) & (minute < b)

    holds = F.coalesce(F.exists(times(day), today), lit(False)) | F.coalesce(F.exists(times(F.pmod(day + 6, lit(7))), yesterday), lit(False))
    known = (F.size(rules) > 0) & F.forall(rules, lambda r: r.rlike(RULE))
    return F.when(F.trim(hours) == "24/7", lit(True)).when(known, holds)


def conditional_value(base: Column, conditional: Column, day: Column, minute: Column) -> Column:
    """A tag's value at a time: that of the last `value @ (hours)` that holds, else the base value; conditions that do not parse never hold."""
    parts = F.regexp_extract_all(conditional, lit(r"([^;@(]+@ *\([^)]*\))"), 1)
    value = lambda p: F.trim(F.get(F.split(p, "@"), lit(0)))
    hours = lambda p: F.regexp_extract(p, r"\(([^)]*)\)", 1)
    held = F.filter(parts, lambda p: F.coalesce(is_open(hours(p), day, minute), lit(False)))
    return F.when(F.size(held) > 0, value(F.element_at(held, -1))).otherwise(base)
