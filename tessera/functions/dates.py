"""Dates as serial numbers of the 1900 system: 0 is 1899-12-31 and 60 a 29 February 1900 that never was."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import number_function, raw_function
from .values import NUM, NUMERIC, VALUE, Val, bind, constant, first_error, num, once, settled, text, to_num, to_text, when

LAST = 2_958_465
FIRST = -693_960


def _trunc(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c)).cast("double")


def serial_of(d: Column) -> Column:
    """Serial of a date or timestamp column, with its time of day as the fraction."""
    day = d.cast("date")
    whole = F.datediff(day, F.lit("1899-12-31").cast("date")) + F.when(day >= F.lit("1900-03-01").cast("date"), 1).otherwise(0)
    t = d.cast("timestamp_ntz")
    seconds = F.hour(t) * 3600 + F.minute(t) * 60 + F.extract(F.lit("SECOND"), t).cast("double")
    return whole.cast("double") + F.coalesce(seconds, F.lit(0.0)) / 86400


def date_of(serial: Column) -> Column:
    """The date of a serial; 60 gives 28 February (see `parts` for the 29th)."""
    day = F.floor(serial).cast("int")
    return F.date_add(F.lit("1899-12-31").cast("date"), F.when(day >= 60, day - 1).otherwise(day))


def parts(serial: Column) -> tuple[Column, Column, Column]:
    serial = once(serial)
    d, leap = once(date_of(serial)), F.floor(serial) == 60
    return F.year(d), F.when(leap, 2).otherwise(F.month(d)), F.when(leap, 29).otherwise(F.dayofmonth(d))


def _month_start(months: Column) -> Column:
    """Serial of the first day of a month counted from year 0."""
    first = bind(months, lambda k: F.make_date(F.floor(k / 12).cast("int"), (F.pmod(k, F.lit(12)) + 1).cast("int"), F.lit(1)))
    return bind(first, _whole_serial)


def _whole_serial(day: Column) -> Column:
    return F.datediff(day, F.lit("1899-12-31").cast("date")) + F.when(day >= F.lit("1900-03-01").cast("date"), 1).otherwise(0)


def parsed_date(t: Column) -> Column:
    """Serial of ISO (y-m-d) or slash (m/d/y, or d/m/y when the first exceeds 12) text; null if it is no date."""
    iso, slash = r"^(\d{1,4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{1,4})$"

    def three(head: Column) -> Column:
        g = lambda p, i: F.regexp_extract(head, p, i).try_cast("int")
        a, b = g(slash, 1), g(slash, 2)
        swap = (a > 12) & (b <= 12)
        is_iso = head.rlike(iso)
        y = F.when(is_iso, g(iso, 1)).otherwise(g(slash, 3))
        return F.struct(y.alias("y"), F.when(is_iso, g(iso, 2)).when(swap, b).otherwise(a).alias("m"), F.when(is_iso, g(iso, 3)).when(swap, a).otherwise(b).alias("d"))

    def serial(p: Column) -> Column:
        good = p["m"].between(1, 12) & p["d"].between(1, 31)
        year = F.when(p["y"] < 1900, p["y"] + 1900).otherwise(p["y"])
        months = F.when(good, year * 12 + p["m"] - 1)
        ends = F.struct(_month_start(months).alias("first"), _month_start(months + 1).alias("after"), p["d"].alias("d"))
        return bind(ends, lambda e: F.when(e["first"] + e["d"] - 1 < e["after"], (e["first"] + e["d"] - 1).cast("double")))

    return bind(bind(F.substring_index(F.substring_index(F.trim(t), "T", 1), " ", 1), three), serial)


def date_arg(v: Val) -> Val:
    """A whole serial from a number, date text or numeric text."""
    if v.kind == "text":
        raw = bind(F.trim(v.col), lambda t: F.coalesce(parsed_date(t), F.when(t.rlike(NUMERIC), t.try_cast("double"))))
        n = num(raw, v.err, when(raw.isNull(), VALUE))
    else:
        n = to_num(v)
    day = once(F.floor(n.col).cast("double"))
    return settled(num(day, n.err, when((day < 0) | (day > LAST), NUM)))


def _int(v: Val | None, spare: float = 0) -> Val:
    n = to_num(constant(spare) if v is None else v)
    return Val("num", _trunc(n.col).cast("long"), n.err)


@raw_function("DATE", 3)
def _date(y: Val, m: Val, d: Val) -> Val:
    a, b, c = _int(y), _int(m), _int(d)
    year = F.when(a.col.between(0, 1899), a.col + 1900).otherwise(a.col)
    months = year * 12 + b.col - 1
    serial = bind(months, lambda k: _month_start(F.when((k >= 0) & (k < 120_000), k))) + c.col - 1
    out = bind(serial, lambda x: F.when(x.between(0, LAST), x.cast("double")))
    return settled(num(out, a.err, b.err, c.err, when(out.isNull(), NUM)))


def _part(i: int):
    def build(v: Val) -> Val:
        n = to_num(v)
        day = F.floor(n.col)
        bad = once((day < FIRST) | (day > LAST))
        return settled(num(parts(F.when(~bad, n.col))[i].cast("double"), n.err, when(bad, NUM)))

    return build


for _i, _name in enumerate(("YEAR", "MONTH", "DAY")):
    raw_function(_name, 1)(_part(_i))


@raw_function("DATEVALUE", 1)
def _datevalue(v: Val) -> Val:
    t = to_text(v)
    day = parsed_date(t.col)
    return settled(num(day, t.err, when(day.isNull(), VALUE)))


def parsed_time(t: Column) -> Column:
    """Fraction of a day of h:m[:s] text with an optional date before and AM or PM after; null if it is no time."""
    shape = r"(?i)^(?:(\S+)[T ]\s*)?(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?\s*(am|pm)?$"

    def pieces(s: Column) -> Column:
        g = lambda i: F.regexp_extract(s, shape, i)
        return F.struct(s.rlike(shape).alias("ok"), g(1).alias("date"), g(2).try_cast("int").alias("h"), g(3).try_cast("int").alias("m"), F.coalesce(g(4).try_cast("double"), F.lit(0.0)).alias("s"), F.lower(g(5)).alias("half"))

    def fraction(p: Column) -> Column:
        hour = F.when(p["half"] == "", F.when(p["h"] < 24, p["h"])).when(p["h"].between(1, 12), p["h"] % 12 + F.when(p["half"] == "pm", 12).otherwise(0))
        dated = (p["date"] == "") | parsed_date(p["date"]).isNotNull()
        return F.when(p["ok"] & dated & (p["m"] < 60) & (p["s"] < 60), (hour * 3600 + p["m"] * 60 + p["s"]) / 86400)

    return bind(bind(F.trim(t), pieces), fraction)


@raw_function("TIMEVALUE", 1)
def _timevalue(v: Val) -> Val:
    t = to_text(v)
    part = parsed_time(t.col)
    return settled(num(part, t.err, when(part.isNull(), VALUE)))


@raw_function("TIME", 3)
def _time(h: Val, m: Val, s: Val) -> Val:
    a, b, c = _int(h), _int(m), _int(s)
    bad = F.greatest(a.col, b.col, c.col) > 32767
    bad = bad | (F.least(a.col, b.col, c.col) < 0)
    return settled(num(F.pmod(a.col * 3600 + b.col * 60 + c.col, F.lit(86400)) / F.lit(86400.0), a.err, b.err, c.err, when(bad, NUM)))


def _clock(how):
    def build(v: Val) -> Val:
        if v.kind == "text":
            raw = bind(F.trim(v.col), lambda t: F.coalesce(parsed_time(t), F.when(t.rlike(NUMERIC), t.try_cast("double")), parsed_date(t)))
            n = num(raw, v.err, when(raw.isNull(), VALUE))
        else:
            n = to_num(v)
        return settled(num(bind(n.col, lambda x: how(F.floor((x - F.floor(x)) * 86400 + 1e-9)).cast("double")), n.err))

    return build


raw_function("HOUR", 1)(_clock(lambda s: F.floor(s / 3600)))
raw_function("MINUTE", 1)(_clock(lambda s: F.floor(s % 3600 / 60)))
raw_function("SECOND", 1)(_clock(lambda s: s % 60))


@raw_function("DAYS", 2)
def _days(end: Val, start: Val) -> Val:
    a, b = date_arg(end), date_arg(start)
    return settled(num(a.col - b.col, a.err, b.err))


def _shifted(v: Val, months: Val, to_end: bool) -> Val:
    s, k = date_arg(v), _int(months)
    def moved(p: Column) -> Column:
        total = F.when((p["t"] >= 0) & (p["t"] < 119_999), p["t"])
        last = _month_start(total + 1) - 1
        return last if to_end else F.least(_month_start(total) + p["d"] - 1, last)

    y, m, d = parts(s.col)
    out = bind(F.struct((y * 12 + m - 1 + k.col).alias("t"), d.alias("d")), moved)
    out = bind(out, lambda x: F.when(x.between(0, LAST), x.cast("double")))
    return settled(num(out, s.err, k.err, when(s.col.isNotNull() & out.isNull(), NUM)))


raw_function("EDATE", 2)(lambda v, m: _shifted(v, m, False))
raw_function("EOMONTH", 2)(lambda v, m: _shifted(v, m, True))


def weekday0(serial: Column) -> Column:
    """0 for Sunday, by the serial alone."""
    return F.pmod(F.floor(serial) + 6, F.lit(7))


@raw_function("WEEKDAY", 1, 2)
def _weekday(v: Val, kind: Val | None = None) -> Val:
    s, k = date_arg(v), _int(kind, 1)
    w = once(weekday0(s.col))
    monday = F.pmod(w - 1, F.lit(7))
    out = F.when(k.col == 1, w + 1).when(k.col.isin(2, 11), monday + 1).when(k.col == 3, monday).when(k.col.between(12, 17), F.pmod(w - (k.col - 10), F.lit(7)) + 1)
    return settled(num(out.cast("double"), s.err, k.err, when(out.isNull() & s.col.isNotNull(), NUM)))


@raw_function("WEEKNUM", 1, 2)
def _weeknum(v: Val, kind: Val | None = None) -> Val:
    s, k = date_arg(v), _int(kind, 1)
    first = F.when(k.col.isin(1, 17), 0).when(k.col.isin(2, 11), 1).when(k.col.between(12, 16), k.col - 10)
    year = bind(s.col, lambda x: _month_start(F.year(date_of(x)).cast("long") * 12))
    plain = bind(F.struct(year.alias("start"), s.col.alias("s"), first.alias("first")), lambda p: F.floor((p["s"] - p["start"] + F.pmod(weekday0(p["start"]) - p["first"], F.lit(7))) / 7) + 1)
    out = F.when(k.col == 21, F.weekofyear(F.when(s.col == 60, F.date_add(date_of(s.col), 1)).otherwise(date_of(s.col)))).otherwise(plain)
    return settled(num(out.cast("double"), s.err, k.err, when(out.isNull() & s.col.isNotNull(), NUM)))


def _holidays(v: Val | None) -> list[Val]:
    if v is None:
        return []
    return [date_arg(h) for h in (v.src if isinstance(v.src, list) else [v]) if h.kind != "blank"]


def _weekdays_upto(s: Column) -> Column:
    """Weekdays among serials 0..s."""
    n = F.floor(s) + 1
    return F.floor(n / 7) * 5 + F.greatest(F.lit(0), F.least(n % 7 - 0, F.lit(7)) - F.when(n % 7 >= 1, 1).otherwise(0) - F.when(n % 7 >= 2, 1).otherwise(0))


@raw_function("NETWORKDAYS", 2, 3)
def _networkdays(start: Val, end: Val, holidays: Val | None = None) -> Val:
    a, b, free = date_arg(start), date_arg(end), _holidays(holidays)
    lo, hi = once(F.least(a.col, b.col)), once(F.greatest(a.col, b.col))
    # serial 0 is a Saturday and 1 a Sunday, so of every seven serials from 0 the first two are days off
    count = _weekdays_upto(hi) - _weekdays_upto(lo - 1)
    if free:
        days = F.array_distinct(F.array(*[h.col for h in free]))
        count = count - F.size(F.filter(days, lambda h: (h >= lo) & (h <= hi) & ~weekday0(h).isin(0, 6)))
    out = F.when(a.col <= b.col, count).otherwise(-count)
    return settled(num(out.cast("double"), a.err, b.err, *[h.err for h in free]))


def _after_weekdays(s: Column, n: Column) -> Column:
    """The serial n weekdays (n > 0) after s: whole weeks, then the rest of one, which may pass a weekend."""
    # Saturday is 0, Sunday 1, Friday 6; a start on a weekend counts as the Friday before
    place = F.pmod(F.floor(s), F.lit(7))
    friday = F.floor(s) - F.when(place < 2, place + 1).otherwise(0)
    day = F.when(place < 2, F.lit(4)).otherwise(place - 2)
    return friday + F.floor((n + day) / 5) * 7 + F.pmod(n + day, F.lit(5)) - day


def _before_weekdays(s: Column, n: Column) -> Column:
    """The serial n weekdays before s."""
    place = F.pmod(F.floor(s), F.lit(7))
    monday = F.floor(s) + F.when(place < 2, 2 - place).otherwise(0)
    left = F.when(place < 2, F.lit(4)).otherwise(6 - place)
    return monday - F.floor((n + left) / 5) * 7 - F.pmod(n + left, F.lit(5)) + left


@raw_function("WORKDAY", 2, 3)
def _workday(start: Val, days: Val, holidays: Val | None = None) -> Val:
    s, k, free = date_arg(start), _int(days), _holidays(holidays)
    ahead, n = k.col > 0, F.abs(k.col).cast("long")
    step = lambda x, many: F.when(ahead, _after_weekdays(x, many)).otherwise(_before_weekdays(x, many))
    out = F.when(n == 0, s.col).otherwise(bind(s.col, lambda x: step(x, n)))
    if free:
        # holidays on weekdays, nearest first: each one on or before the day found so far moves it on by a weekday
        nth = F.array_sort(F.transform(F.array_distinct(F.array(*[F.floor(h.col) for h in free])), lambda h: F.when(ahead, h).otherwise(-h)))
        counts = lambda h: ~weekday0(F.abs(h)).isin(0, 6) & F.when(ahead, h > F.floor(s.col)).otherwise(-h < F.floor(s.col))
        move = lambda at, h: F.when(F.when(ahead, h <= at).otherwise(-h >= at), step(at, F.lit(1).cast("long"))).otherwise(at)
        moved = F.aggregate(F.filter(nth, counts), out.cast("double"), lambda at, h: move(at, h).cast("double"))
        out = F.when(n == 0, s.col).otherwise(moved)
    out = out.cast("double")
    return settled(num(out, s.err, k.err, *[h.err for h in free], when(out.isNull() | (out < 0) | (out > LAST), NUM)))


def _split(lo: Column, hi: Column) -> Column:
    (y1, m1, d1), (y2, m2, d2) = parts(lo), parts(hi)
    return F.struct(*[c.alias(n) for c, n in zip((y1, m1, d1, y2, m2, d2), ("y1", "m1", "d1", "y2", "m2", "d2"))])


def _days360(lo: Column, hi: Column, european: Column) -> Column:
    last = lambda y: F.when(_leap(y), 29).otherwise(28)

    def ends(p: Column) -> Column:
        f1, f2 = (p["m1"] == 2) & (p["d1"] == last(p["y1"])), (p["m2"] == 2) & (p["d2"] == last(p["y2"]))
        return F.struct(F.when(f1, 30).otherwise(p["d1"]).alias("s"), F.when(f1 & f2, 30).otherwise(p["d2"]).alias("e"))

    def count(p: Column) -> Column:
        us = bind(ends(p), lambda q: F.when((q["e"] == 31) & (q["s"] >= 30), 30).otherwise(q["e"]) - F.least(q["s"], F.lit(30)))
        eu = F.least(p["d2"], F.lit(30)) - F.least(p["d1"], F.lit(30))
        return (p["y2"] - p["y1"]) * 360 + (p["m2"] - p["m1"]) * 30 + F.when(european, eu).otherwise(us)

    return bind(_split(lo, hi), count)


@raw_function("DAYS360", 2, 3)
def _days360_fn(start: Val, end: Val, european: Val | None = None) -> Val:
    from .values import to_bool

    a, b, e = date_arg(start), date_arg(end), to_bool(european or constant(False))
    return settled(num(_days360(a.col, b.col, e.col).cast("double"), a.err, b.err, e.err))


def _leap(y: Column) -> Column:
    return (y == 1900) | ((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)))


@raw_function("YEARFRAC", 2, 3)
def _yearfrac(start: Val, end: Val, basis: Val | None = None) -> Val:
    a, b, k = date_arg(start), date_arg(end), _int(basis, 0)
    lo, hi = once(F.least(a.col, b.col)), once(F.greatest(a.col, b.col))
    days = hi - lo
    year0 = lambda y: _month_start(y.cast("long") * 12)
    feb29 = lambda y: F.when(_leap(y), _month_start(y.cast("long") * 12 + 1) + 28)

    def divisor(p: Column) -> Column:
        short = (p["y1"] == p["y2"]) | ((p["y2"] == p["y1"] + 1) & ((p["m2"] * 100 + p["d2"]) <= (p["m1"] * 100 + p["d1"])))
        holds = F.coalesce(feb29(p["y1"]).between(lo, hi - 1), F.lit(False)) | F.coalesce(feb29(p["y2"]).between(lo, hi - 1), F.lit(False))
        return F.when(short, F.when(holds, 366.0).otherwise(365.0)).otherwise((year0(p["y2"] + 1) - year0(p["y1"])) / (p["y2"] - p["y1"] + 1))

    actual = F.when(days == 0, 0.0).otherwise(days / bind(_split(lo, hi), divisor))
    out = F.when(k.col == 0, _days360(lo, hi, F.lit(False)) / 360.0).when(k.col == 1, actual).when(k.col == 2, days / 360.0).when(k.col == 3, days / 365.0).when(k.col == 4, _days360(lo, hi, F.lit(True)) / 360.0)
    return settled(num(F.when(a.col <= b.col, out).otherwise(-out), a.err, b.err, k.err, when(~k.col.between(0, 4), NUM)))


#: The date formats of TEXT, as Java patterns.
DATE_FORMATS = {"yyyy-mm-dd": "yyyy-MM-dd", "yyyy/mm/dd": "yyyy/MM/dd", "mm/dd/yyyy": "MM/dd/yyyy", "dd/mm/yyyy": "dd/MM/yyyy", "m/d/yyyy": "M/d/yyyy", "yyyy-mm-dd hh:mm": "yyyy-MM-dd HH:mm", "yyyy-mm-dd hh:mm:ss": "yyyy-MM-dd HH:mm:ss", "hh:mm": "HH:mm", "hh:mm:ss": "HH:mm:ss"}


def date_text(serial: Column, fmt: str) -> Column | None:
    pattern = DATE_FORMATS.get(fmt.lower())
    if pattern is None:
        return None
    return rendered(serial, pattern)


def rendered(serial: Column, pattern: str) -> Column:
    """A serial in a pattern of Spark's date_format."""
    seconds = F.pmod(F.round((serial - F.floor(serial)) * 86400).cast("long"), F.lit(86400))
    return F.date_format(F.timestamp_seconds(F.unix_date(date_of(serial)).cast("long") * 86400 + seconds), pattern)


__all__ = ["first_error", "number_function", "text"]
