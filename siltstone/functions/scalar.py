"""Scalar functions with the dialect's meaning, as compositions of Spark's own expressions.

Booleans are 1 and 0, out-of-range arguments give null, and bit operations are unsigned with
64 bits. Choices that the dialect leaves open are told with each function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2**64, as a decimal of 20 digits.
_TWO_64 = "18446744073709551616"


def _text(x: Column) -> Column:
    return x.cast("string")


# -- strings ---------------------------------------------------------------------------------

def elt(n: Column, *values: Column) -> Column:
    """The n-th value, null outside 1 to the number of values."""
    return F.get(F.array(*map(_text, values)), n.cast("int") - 1)


def field(x: Column, *values: Column) -> Column:
    """The place of ``x`` among the values, from 1; 0 if it is null or not there."""
    return F.coalesce(F.array_position(F.array(*values), x), F.lit(0)).cast("int")


def find_in_set(x: Column, csv: Column) -> Column:
    """The place of ``x`` in a comma list; 0 if it isn't there or has a comma."""
    return F.find_in_set(x, csv)


def make_set(bits: Column, *values: Column) -> Column:
    """The values whose bit is on, joined by commas; nulls are left out."""
    on = [F.when(F.getbit(bits.cast("long"), F.lit(i)) == 1, _text(v)) for i, v in enumerate(values)]
    return F.when(bits.isNotNull(), F.concat_ws(",", *on))


def export_set(bits: Column, on: Column, off: Column, sep: str = ",", n: int = 64) -> Column:
    """``on`` or ``off`` for each of the ``n`` lowest bits, lowest first."""
    marks = [F.when(F.getbit(bits.cast("long"), F.lit(i)) == 1, on).otherwise(off) for i in range(min(max(n, 0), 64))]
    return F.when(bits.isNotNull() & on.isNotNull() & off.isNotNull(), F.concat_ws(sep, *marks))


def interval_index(n: Column, *bounds: Column) -> Column:
    """How many of the ascending bounds are not above ``n``; -1 for null."""
    count = sum((F.when(b <= n, 1).otherwise(0) for b in bounds), F.lit(0))
    return F.when(n.isNull(), -1).otherwise(count).cast("int")


def insert(s: Column, pos: Column, length: Column, new: Column) -> Column:
    """``s`` with ``length`` characters from ``pos`` replaced; unchanged if ``pos`` is outside."""
    n = F.char_length(s)
    rest = F.when((length < 0) | (pos + length > n), F.lit("")).otherwise(F.substr(s, pos + length))
    return F.when((pos < 1) | (pos > n), s).otherwise(F.concat(F.substr(s, F.lit(1), pos - 1), new, rest))


def trim_whole(s: Column, what: str, side: str = "both") -> Column:
    """Strip whole copies of a string, not any of its characters."""
    import re

    quoted = re.escape(what)
    if side in ("both", "leading"):
        s = F.regexp_replace(s, f"^(?:{quoted})+", "")
    if side in ("both", "trailing"):
        s = F.regexp_replace(s, f"(?:{quoted})+$", "")
    return s


def mid(s: Column, pos: Column, length: Column | None = None) -> Column:
    """Substring from ``pos``, from the end if negative; empty for 0."""
    part = F.substr(s, pos, length) if length is not None else F.substr(s, pos)
    return F.when(pos == 0, F.lit("")).otherwise(part)


def ord_(s: Column) -> Column:
    """The bytes of the first character as one number; 0 for empty text."""
    return F.when(s == "", 0).otherwise(F.conv(F.hex(F.encode(F.left(s, F.lit(1)), "UTF-8")), 16, 10).cast("long"))


def quote(s: Column) -> Column:
    """A literal of the dialect: quotes and backslashes escaped; the word NULL for null."""
    escaped = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.when(s.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))


def strcmp(a: Column, b: Column, binary: bool = False) -> Column:
    """-1, 0 or 1, without regard to case and trailing blanks, the dialect's usual collation, unless ``binary``."""
    if not binary:
        a, b = F.collate(a, "UTF8_LCASE_RTRIM"), F.collate(b, "UTF8_LCASE_RTRIM")
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def soundex(s: Column) -> Column:
    """Phonetic code of any length, at least four places: the first letter, then a digit for
    each following group of like consonants; vowels, h, w and y are skipped."""
    letters = F.regexp_replace(F.upper(s), "[^A-Z]", "")
    digits = F.translate(letters, "BFPVCGJKQSXZDTLMNRAEIOUHWY", "111122222222334556" + "0" * 8)
    single = F.regexp_replace(F.regexp_replace(digits, "(.)\\1+", "$1"), "0", "")
    first = F.left(F.translate(F.left(letters, F.lit(1)), "BFPVCGJKQSXZDTLMNRAEIOUHWY", "111122222222334556" + "0" * 8), F.lit(1))
    rest = F.when((first != "0"), F.substr(single, F.lit(2))).otherwise(single)
    code = F.concat(F.left(letters, F.lit(1)), rest)
    return F.when(letters == "", F.lit("")).otherwise(F.rpad(code, F.greatest(F.lit(4), F.char_length(code)), F.lit("0")))


def sounds_like(a: Column, b: Column) -> Column:
    return (soundex(a) == soundex(b)).cast("int")


def hex_(x: Column, numeric: bool) -> Column:
    return F.hex(x.cast("long")) if numeric else F.hex(F.encode(_text(x), "UTF-8"))


def convert_using(s: Column, charset: str) -> Column:
    """There and back through a character set; what it lacks becomes a question mark."""
    return F.regexp_replace(s, "[^\\x00-\\x7f]", "?") if charset.lower() in ("ascii", "us-ascii") else F.decode(F.encode(s, charset), charset)


def char_of(*codes: Column) -> Column:
    """The characters of codes below 256; nulls are left out."""
    return F.concat_ws("", *[F.when(c.isNotNull(), F.chr(c)) for c in codes])


def posix_regex(pattern: str) -> str:
    """A pattern of the dialect for Java: bracketed classes and word boundaries."""
    names = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space",
             "punct": "Punct", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "xdigit": "XDigit"}
    pattern = pattern.replace("[[:<:]]", r"\b(?=\w)").replace("[[:>:]]", r"\b(?<=\w)")
    for k, v in names.items():
        pattern = pattern.replace(f"[:{k}:]", rf"\p{{{v}}}")
    return pattern


def regexp(s: Column, pattern: str, binary: bool = False) -> Column:
    return s.rlike(("" if binary else "(?i)") + posix_regex(pattern)).cast("int")


def like(s: Column, pattern: str, escape: str = "\\", binary: bool = False) -> Column:
    """Wildcards match without regard to case unless the operand is binary."""
    return (F.like if binary else F.ilike)(s, F.lit(pattern), F.lit(escape)).cast("int")


def equal_text(a: Column, b: Column) -> Column:
    """Equality without regard to case and trailing blanks, the dialect's usual collation."""
    return (F.collate(a, "UTF8_LCASE_RTRIM") == F.collate(b, "UTF8_LCASE_RTRIM")).cast("int")


def number_prefix(s: Column) -> Column:
    """A text as a number: its longest numeric beginning, 0 if there is none."""
    found = F.regexp_extract(F.trim(s), r"^([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?))", 1)
    return F.when(s.isNull(), None).otherwise(F.when(found == "", 0.0).otherwise(found.try_cast("double")))


# -- numbers and bits ------------------------------------------------------------------------

def divide(a: Column, b: Column, scale: int = 4) -> Column:
    """Exact division with four decimals more than the dividend's; null by zero."""
    return F.when(b != 0, F.round(a.cast("decimal(28,8)") / F.when(b != 0, b).cast("decimal(28,8)"), scale).cast(f"decimal(28,{scale})"))


def int_divide(a: Column, b: Column) -> Column:
    """Whole division towards zero, exact for 64-bit numbers and decimals of ten places; null by zero."""
    wide = "decimal(38,10)"
    return F.when(b != 0, F.call_function("div", a.cast(wide), F.when(b != 0, b).cast(wide))).cast("long")


def modulo(a: Column, b: Column) -> Column:
    return F.when(b != 0, a % F.when(b != 0, b))


def unsigned(x: Column) -> Column:
    """A signed 64-bit number read as unsigned."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit(_TWO_64).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def bit_or(a: Column, b: Column) -> Column:
    return unsigned(a.cast("long").bitwiseOR(b.cast("long")))


def bit_and(a: Column, b: Column) -> Column:
    return unsigned(a.cast("long").bitwiseAND(b.cast("long")))


def bit_xor(a: Column, b: Column) -> Column:
    return unsigned(a.cast("long").bitwiseXOR(b.cast("long")))


def bit_not(a: Column) -> Column:
    return unsigned(F.bitwise_not(a.cast("long")))


def shift_left(a: Column, n: int) -> Column:
    """Zero from 64 places on."""
    return unsigned(F.shiftleft(a.cast("long"), n)) if 0 <= n < 64 else F.lit(0).cast("decimal(20,0)")


def shift_right(a: Column, n: int) -> Column:
    return unsigned(F.shiftrightunsigned(a.cast("long"), n)) if 0 <= n < 64 else F.lit(0).cast("decimal(20,0)")


def truncate(x: Column, d: int) -> Column:
    """Cut to ``d`` decimals (below zero: to tens, hundreds) towards zero. Exact, as a decimal of 15 places; null from 10**23 on."""
    exact = x.try_cast("decimal(38,15)")
    if d >= 0:
        cut = F.floor(F.abs(exact), F.lit(min(d, 15)))
    else:
        unit = F.lit(10 ** -d).cast("decimal(23,0)")
        cut = F.call_function("div", F.abs(exact), unit).cast("decimal(38,0)") * unit
    return F.when(exact < 0, -cut).otherwise(cut)


def clamp_int(x: Column, low: int, high: int) -> Column:
    """A decimal stored in a whole-number column: rounded half away from zero, kept in range."""
    return F.when(x.isNotNull(), F.least(F.greatest(F.round(x.cast("decimal(38,6)")), F.lit(low)), F.lit(high))).cast("decimal(20,0)")


def greatest(*xs: Column) -> Column:
    """Null if any argument is null."""
    return F.when(~_any_null(xs), F.greatest(*xs))


def least(*xs: Column) -> Column:
    return F.when(~_any_null(xs), F.least(*xs))


def _any_null(xs) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | x.isNull()
    return out


def xor(a: Column, b: Column) -> Column:
    return ((a != 0) != (b != 0)).cast("int")


def truth(x: Column, test: str) -> Column:
    """``IS [NOT] TRUE``, ``FALSE`` or ``UNKNOWN`` of a number."""
    word = test.lower().split()
    found = {"true": F.coalesce(x != 0, F.lit(False)), "false": F.coalesce(x == 0, F.lit(False)), "unknown": x.isNull()}[word[-1]]
    return (~found if word[0] == "not" else found).cast("int")


# -- dates and times -------------------------------------------------------------------------

#: The dialect's date patterns and Spark's.
DATE_PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "M": "MMMM", "b": "MMM", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh",
    "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a",
}


def date_format(ts: Column, pattern: str) -> Column:
    """``%`` patterns; unknown letters stand for themselves, ``%w`` and ``%D`` included."""
    parts, i, plain = [], 0, ""
    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            letter = pattern[i + 1]
            if plain:
                parts.append(F.lit(plain))
                plain = ""
            if letter == "w":
                parts.append(_text(F.dayofweek(ts) - 1))
            elif letter == "D":
                d = F.dayofmonth(ts)
                end = F.when(d.between(11, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
                parts.append(F.concat(_text(d), end))
            elif letter in DATE_PATTERNS:
                parts.append(F.date_format(ts, DATE_PATTERNS[letter]))
            else:
                plain += letter
            i += 2
        else:
            plain += pattern[i]
            i += 1
    if plain:
        parts.append(F.lit(plain))
    return F.concat(*parts) if parts else F.lit("")


def to_days(d: Column) -> Column:
    """Days since year 0."""
    return F.datediff(d, F.lit("1970-01-01").cast("date")) + 719528


def from_days(n: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (n - 719528).cast("int"))


def period_months(p: Column) -> Column:
    """A period YYMM or YYYYMM as months since year 0; two-digit years below 70 are in 2000."""
    year = F.floor(p / 100)
    year = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return (year * 12 + p % 100 - 1).cast("long")


def period_add(p: Column, n: Column) -> Column:
    months = period_months(p) + n
    return (F.floor(months / 12) * 100 + months % 12 + 1).cast("long")


def period_diff(a: Column, b: Column) -> Column:
    return period_months(a) - period_months(b)


def week(d: Column, mode: int = 0) -> Column:
    """Week of the year in the dialect's eight modes: bit 0 starts weeks on Monday, bit 1 counts
    from 1 (days before the first week belong to the old year), bit 2 flips whether the first
    week is the one with the first such weekday or the one with four days."""
    monday, from_one = bool(mode & 1), bool(mode & 2)
    full = bool(mode & 4) == monday  # the first week begins with the year's first such weekday

    def number(day: Column, year: Column) -> Column:
        new_year = F.make_date(year, F.lit(1), F.lit(1))
        weekday = F.weekday(new_year) if monday else F.dayofweek(new_year) - 1
        start = F.when(weekday == 0, F.lit(0)).otherwise(7 - weekday) if full else F.when(weekday <= 3, -weekday).otherwise(7 - weekday)
        return F.floor((F.datediff(day, new_year) - start) / 7) + 1

    own = number(d, F.year(d))
    if not from_one:
        return F.greatest(own, F.lit(0)).cast("int")
    before = number(d, F.year(d) - 1)
    after = number(d, F.year(d) + 1)
    return F.when(own < 1, before).when(after >= 1, after).otherwise(own).cast("int")


def yearweek(d: Column, mode: int = 0) -> Column:
    w = week(d, mode | 2)
    year = F.when((F.month(d) == 1) & (w > 50), F.year(d) - 1).when((F.month(d) == 12) & (w == 1), F.year(d) + 1).otherwise(F.year(d))
    return (year * 100 + w).cast("int")


def time_of(text: Column) -> Column:
    """``[-]H..H:MM:SS`` as seconds, kept within 838:59:59; null if it isn't a time."""
    m = F.regexp_extract(text, r"^-?(\d+):[0-5]\d:[0-5]\d$", 1)
    part = F.split(F.regexp_replace(text, "^-", ""), ":")
    seconds = F.when(m != "", F.get(part, F.lit(0)).try_cast("long") * 3600 + F.get(part, F.lit(1)).try_cast("long") * 60 + F.get(part, F.lit(2)).try_cast("long"))
    return F.when(seconds.isNotNull(), F.least(seconds, F.lit(838 * 3600 + 3599)) * F.when(text.startswith("-"), -1).otherwise(1))


def sec_to_time(n: Column, most: int | None = 838 * 3600 + 3599) -> Column:
    """Seconds as ``[-]HH:MM:SS``, kept within ``most`` (None: whole, with as many hours as there are)."""
    if most is not None:
        n = F.when(n.isNotNull(), F.greatest(F.least(n, F.lit(most)), F.lit(-most)))
    n = n.cast("long")
    a = F.abs(n)
    return F.concat(F.when(n < 0, "-").otherwise(""), F.lpad(_text(F.floor(a / 3600)), F.greatest(F.lit(2), F.length(_text(F.floor(a / 3600)))), F.lit("0")),
                    F.lit(":"), F.lpad(_text(F.floor(a / 60) % 60), 2, "0"), F.lit(":"), F.lpad(_text(a % 60), 2, "0"))


def add_time(a: Column, b: Column, sign: int = 1) -> Column:
    """ADDTIME and SUBTIME of two times in seconds, kept within 838:59:59."""
    most = F.lit(838 * 3600 + 3599)
    total = a + sign * b
    return F.when(total.isNotNull(), F.least(F.greatest(total, -most), most))


def make_time(hours: Column, minutes: Column, seconds: Column) -> Column:
    """A time in seconds, kept within 838:59:59; null for minutes or seconds outside 0 to 59."""
    whole = (F.abs(hours) * 3600 + minutes * 60 + seconds).cast("long")
    whole = F.when(whole.isNotNull(), F.least(whole, F.lit(838 * 3600 + 3599).cast("long"))) * F.when(hours < 0, -1).otherwise(1)
    return F.when(minutes.between(0, 59) & seconds.between(0, 59), whole)


def time_format(seconds: Column, pattern: str) -> Column:
    """TIME_FORMAT of a time in seconds, for %H %k %h %I %l %i %s %S %p %T %r. %H and %k can pass 24."""
    hour, minute, second = F.floor(F.abs(seconds) / 3600), F.floor(F.abs(seconds) / 60) % 60, F.abs(seconds) % 60
    twelve = (hour + 11) % 12 + 1
    two = lambda x: F.lpad(_text(x), F.greatest(F.lit(2), F.length(_text(x))), F.lit("0"))
    half = F.when(hour % 24 < 12, "AM").otherwise("PM")
    known = {"H": two(hour), "k": _text(hour), "h": two(twelve), "I": two(twelve), "l": _text(twelve), "i": two(minute), "s": two(second),
             "S": two(second), "p": half, "T": F.concat_ws(":", two(hour), two(minute), two(second)),
             "r": F.concat(F.concat_ws(":", two(twelve), two(minute), two(second)), F.lit(" "), half)}
    parts, i = [], 0
    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            parts.append(known.get(pattern[i + 1], F.lit(pattern[i + 1])))
            i += 2
        else:
            parts.append(F.lit(pattern[i]))
            i += 1
    return F.when(seconds.isNotNull(), F.concat(F.when((seconds < 0) & F.lit(pattern[:2] in ("%H", "%k", "%T")), "-").otherwise(""), *parts))


def extract(unit: str, ts: Column) -> Column:
    """EXTRACT of one field, or of a run of them such as ``day_minute`` as one number."""
    fields = ["year", "month", "day", "hour", "minute", "second", "microsecond"]
    value = {"year": F.year(ts), "month": F.month(ts), "day": F.day(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts),
             "microsecond": F.unix_micros(ts.cast("timestamp")) % 1000000, "quarter": F.quarter(ts), "week": week(F.to_date(ts), 0)}
    if "_" not in unit:
        return value[unit].cast("long")
    first, last = unit.split("_")
    out = F.lit(0).cast("long")
    for name in fields[fields.index(first): fields.index(last) + 1]:
        out = out * (1_000_000 if name == "microsecond" else 100) + value[name]
    return out


def add_interval(ts: Column, n: Column, unit: str) -> Column:
    """A date and time plus an interval; null outside the years 0 to 9999."""
    months = {"month": 1, "quarter": 3, "year": 12}
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    if unit in months:
        moved = ts + F.make_interval(months=(n * months[unit]).cast("int"))
    else:
        moved = ts + F.make_dt_interval(secs=(n * seconds[unit]).cast("decimal(18,6)"))
    return F.when(F.year(moved).between(0, 9999), moved)


def year_of_two_digits(y: Column) -> Column:
    return F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)


def str_to_date(s: Column, pattern: str) -> Column:
    """A date and time from a text by ``%`` patterns, null if it doesn't fit; fields that the pattern lacks are those of 1970-01-01 00:00:00.
    For %Y %y %m %c %M %b %d %e %H %k %h %I %l %i %s %S %f %p %j %T %r."""
    java, i, plain = "", 0, ""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'" if text else ""

    while i < len(pattern):
        letter = pattern[i + 1] if pattern[i] == "%" and i + 1 < len(pattern) else None
        if letter in ("W", "a"):
            raise ValueError("names of weekdays are not parsed")
        if letter in DATE_PATTERNS:
            java, plain = java + quoted(plain) + DATE_PATTERNS[letter], ""
        else:
            plain += letter or pattern[i]
        i += 2 if letter else 1
    return F.try_to_timestamp(s, F.lit(java + quoted(plain))).cast("timestamp_ntz")


def timediff(a: Column, b: Column) -> Column:
    """TIMEDIFF of two dates with times as a time, kept within 838:59:59."""
    return sec_to_time(F.unix_seconds(a.cast("timestamp")) - F.unix_seconds(b.cast("timestamp")))


def cast_time(x: Column) -> Column:
    """CAST AS TIME of a text: ``[D ]H:M:S``, ``H:M``, a number ``HHMMSS``, or the time of a date; null if it is none of these."""
    text = F.trim(x.cast("string"))
    clock = F.regexp_extract(text, r"^(?:\d{1,4}-\d{1,2}-\d{1,2}[ T])?(-?(?:\d+ )?\d+:\d{1,2}(?::\d{1,2})?)(?:\.\d*)?$", 1)
    days = F.coalesce(F.regexp_extract(clock, r"^-?(\d+) ", 1).try_cast("long"), F.lit(0))
    part = F.split(F.regexp_replace(clock, r"^-?(\d+ )?", ""), ":")
    at = lambda i: F.coalesce(F.get(part, F.lit(i)).try_cast("long"), F.lit(0))
    number = F.when(text.rlike(r"^-?\d{1,7}$"), F.abs(text.try_cast("long")))
    h = F.when(clock != "", days * 24 + at(0)).otherwise(F.floor(number / 10000))
    m, s = F.when(clock != "", at(1)).otherwise(F.floor(number / 100) % 100), F.when(clock != "", at(2)).otherwise(number % 100)
    seconds = F.when((m < 60) & (s < 60), h * 3600 + m * 60 + s)
    return sec_to_time(seconds * F.when(text.startswith("-"), -1).otherwise(1))


def cast_datetime(x: Column) -> Column:
    """CAST AS DATETIME of a text: with any marks between the fields, or as a number YYYYMMDD[HHMMSS]; null if it is none."""
    text = F.trim(x.cast("string"))
    number = F.regexp_extract(text, r"^(\d{8}|\d{14})$", 1)
    spread = F.rpad(number, 14, "0")
    field = lambda a, n: F.substr(spread, F.lit(a), F.lit(n))
    written = F.concat_ws(" ", F.concat_ws("-", field(1, 4), field(5, 2), field(7, 2)), F.concat_ws(":", field(9, 2), field(11, 2), field(13, 2)))
    marked = F.regexp_replace(text, r"^(\d{4})\W(\d{1,2})\W(\d{1,2})(?:[T ]+(\d{1,2})\W(\d{1,2})(?:\W(\d{1,2}))?)?$", "$1-$2-$3 $4:$5:$6")
    marked = F.regexp_replace(F.regexp_replace(marked, r" ::$", " 0:0:0"), r":$", ":0")
    return F.try_to_timestamp(F.when(number != "", written).otherwise(marked), F.lit("y-M-d H:m:s")).cast("timestamp_ntz")


def utc_date(at: Column | None = None, zone: str | None = None) -> Column:
    """UTC_DATE() of a moment (now, without one). With ``zone``, ``at`` is a local time there."""
    return F.to_date(utc_timestamp(at, zone))


def utc_time(at: Column | None = None, zone: str | None = None) -> Column:
    return F.date_format(utc_timestamp(at, zone), "HH:mm:ss")


def utc_timestamp(at: Column | None = None, zone: str | None = None) -> Column:
    if at is None:
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
    return F.convert_timezone(F.lit(zone or "UTC"), F.lit("UTC"), at.cast("timestamp_ntz"))


def curtime(at: Column | None = None) -> Column:
    """CURTIME(): the time of the statement (or of ``at``) as text."""
    return F.date_format(F.localtimestamp() if at is None else at, "HH:mm:ss")


def sysdate() -> Column:
    """SYSDATE(): the time at which a row is worked out, not the statement's. Spark has no such function, so this is an Arrow UDF."""
    import pandas as pd

    def clock(s: pd.Series) -> pd.Series:
        return pd.Series([pd.Timestamp.now("UTC")] * len(s))

    clock.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(clock, "timestamp").asNondeterministic()(F.monotonically_increasing_id())


# -- others ----------------------------------------------------------------------------------

def inet_aton(s: Column) -> Column:
    part = F.split(s, r"\.")
    valid = s.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(valid, sum((F.get(part, F.lit(i)).try_cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0)))


def inet_ntoa(n: Column) -> Column:
    return F.when(n.between(0, 2**32 - 1), F.concat_ws(".", *[_text(F.shiftright(n.cast("long"), 8 * (3 - i)).bitwiseAND(F.lit(255))) for i in range(4)]))


def charset(x: Column) -> Column:
    """CHARSET(): text is Unicode here, the rest is binary."""
    return F.when(F.typeof(x).startswith("string") | F.typeof(x).startswith("char") | F.typeof(x).startswith("varchar"), F.lit("utf8")).otherwise("binary")


def collation(x: Column) -> Column:
    """COLLATION(): the name without its catalogue."""
    return F.element_at(F.split(F.collation(x), r"\."), -1)


def name_const(name: str, value) -> Column:
    """A constant under a name."""
    return F.lit(value).alias(name)


def password(s: Column) -> Column:
    return F.when(s == "", F.lit("")).otherwise(F.concat(F.lit("*"), F.upper(F.sha1(F.unhex(F.sha1(s))))))


def fold_key(key: str) -> bytes:
    """A key of any length folded into the sixteen bytes that the cipher takes."""
    out = bytearray(16)
    for i, b in enumerate(key.encode()):
        out[i % 16] ^= b
    return bytes(out)


def aes_encrypt(s: Column, key: str) -> Column:
    return F.aes_encrypt(s, F.lit(fold_key(key)), F.lit("ECB"), F.lit("PKCS"))


def aes_decrypt(s: Column, key: str) -> Column:
    return F.try_aes_decrypt(s, F.lit(fold_key(key)), F.lit("ECB"), F.lit("PKCS")).cast("string")


def _zlib(name: str, result: str):
    import pandas as pd

    def squeeze(s: pd.Series) -> pd.Series:
        import zlib

        data = s.map(lambda x: None if x is None else x if isinstance(x, (bytes, bytearray)) else str(x).encode())
        if name == "compress":
            return data.map(lambda x: None if x is None else b"" if not x else len(x).to_bytes(4, "little") + zlib.compress(x))

        def back(x):
            try:
                return None if x is None else b"" if not x else zlib.decompress(bytes(x[4:]))
            except zlib.error:
                return None

        return data.map(back)

    squeeze.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(squeeze, result)


def compress(s: Column) -> Column:
    """zlib with the length in front: Spark has no such codec, so this is an Arrow UDF."""
    return _zlib("compress", "binary")(s)


def uncompress(b: Column) -> Column:
    return _zlib("uncompress", "binary")(b).cast("string")


def uncompressed_length(b: Column) -> Column:
    """The length in front of a compressed value, little end first."""
    h = F.hex(F.substr(b, F.lit(1), F.lit(4)))
    turned = F.concat(*[F.substr(h, F.lit(2 * i + 1), F.lit(2)) for i in (3, 2, 1, 0)])
    return F.when(F.octet_length(b) == 0, 0).otherwise(F.conv(turned, 16, 10).cast("long"))


def extract_value(xml: Column, path: str) -> Column:
    """The texts at a path, joined by blanks."""
    return F.array_join(F.xpath(xml, F.lit(path if path.endswith(")") else f"{path}/text()")), " ")


def update_xml(xml: Column, path: str, new: str) -> Column:
    """The document with the one element at a path replaced; unchanged if there isn't exactly one.
    Spark has no such function, so this is an Arrow UDF."""
    import pandas as pd

    def change(s: pd.Series) -> pd.Series:
        from xml.etree import ElementTree

        def one(text):
            try:
                root = ElementTree.fromstring(f"<_r>{text}</_r>")
            except ElementTree.ParseError:
                return None
            found = root.findall(f".{path}" if path.startswith("/") else path)
            if len(found) != 1:
                return text
            parent = next(p for p in root.iter() if found[0] in list(p))
            tail, mark = found[0].tail or "", ElementTree.Element("_here")
            at = list(parent).index(found[0])
            parent.remove(found[0])
            mark.tail = tail
            parent.insert(at, mark)
            out = ElementTree.tostring(root, encoding="unicode")[len("<_r>"):-len("</_r>")]
            return out.replace("<_here />", new)

        return s.map(lambda x: None if x is None else one(x))

    change.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(change, "string")(xml)


# -- geometry --------------------------------------------------------------------------------

def geometry(wkt: Column) -> Column:
    """A value from its text: type and coordinates, x and y in turn. Points, lines, polygons and their collections."""
    kind = F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))
    numbers = F.transform(F.regexp_extract_all(wkt, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), 1), lambda x: x.cast("double"))
    return F.when(kind != "", F.struct(kind.alias("type"), numbers.alias("coords")))


def x_of(g: Column) -> Column:
    return F.when(g["type"] == "POINT", F.get(g["coords"], F.lit(0)))


def y_of(g: Column) -> Column:
    return F.when(g["type"] == "POINT", F.get(g["coords"], F.lit(1)))


def envelope(g: Column) -> Column:
    xs, ys = F.filter(g["coords"], lambda _, i: i % 2 == 0), F.filter(g["coords"], lambda _, i: i % 2 == 1)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def mbr_intersects(a: Column, b: Column) -> Column:
    p, q = envelope(a), envelope(b)
    return ((p["x0"] <= q["x1"]) & (q["x0"] <= p["x1"]) & (p["y0"] <= q["y1"]) & (q["y0"] <= p["y1"])).cast("int")


def mbr_contains(a: Column, b: Column) -> Column:
    p, q = envelope(a), envelope(b)
    return ((p["x0"] <= q["x0"]) & (q["x1"] <= p["x1"]) & (p["y0"] <= q["y0"]) & (q["y1"] <= p["y1"])).cast("int")


def point_text(g: Column) -> Column:
    number = lambda c: F.regexp_replace(_text(c), r"\.0$", "")
    return F.concat(F.lit("POINT("), number(x_of(g)), F.lit(" "), number(y_of(g)), F.lit(")"))
