"""Dates and times in a question: tokens folded by a small grammar.

The grammar is one SQL expression, put together from text: as such it is built in no time.
The question becomes an array of tokens, each a struct of what it may be (a number, a month, a
clock, a connecting word). One fold reads them from left to right and keeps the
parts of moments that it has seen: day, month, year, clock, and the word that led to them.
Afterwards parts share what they leave out: in "27 to 29 Oct 2024" the first takes month and
year of the next, in "October 27 to 29, 2024" the second takes its month from the one before, and a
clock alone takes the date of its neighbour.

What looks like a date but cannot be made one ("in October", "28 Oct" without any year, "10/28/2024",
"yesterday") is reported as not understood. A bare number is a day only as one end of a
range with a date, and a clock without any date is no moment.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = r"^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?)$"
#: months that are also plain words: alone they are no date
_WORD_MONTHS = (3, 5)
_ISO = r"\d{4}-\d{1,2}-\d{1,2}(?:t\d{1,2}:\d{2}(?::\d{2})?)?"
_TOKEN = rf"(?U){_ISO}|\d+(?:[/.]\d+){{2}}|\d{{1,2}}:\d{{2}}(?::\d{{2}})?|\d+(?:st|nd|rd|th)\b|\d+|[ap]\.m\.|\w[\w'’]*|[^\s\w]"

_LEADING = {
    "from": "from", "between": "from", "since": "since", "after": "after", "before": "before", "to": "to", "until": "to",
    "till": "to", "til": "to", "through": "to", "-": "to", "–": "to", "—": "to", "and": "and", "then": "and",
}
_PASSED_OVER = (
    "the of at on in , . ? ! ; : ( ) a an about around roughly early late date day time up by just right "
    "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun"
).split()
_CLOCK_WORDS = {"noon": 12 * 3600, "midday": 12 * 3600, "midnight": 0}
_PRESENT = ("now", "today", "present")
_UNCLEAR = ("yesterday", "tomorrow", "tonight")

_FIELDS = {"role": "string", "end_of": "boolean", "day": "int", "month": "int", "year": "int", "clock": "int", "unclear": "boolean", "present": "boolean"}
_PARTS = f"array<struct<{','.join(f'{name}:{kind}' for name, kind in _FIELDS.items())}>>"

#: the end of a window that has none; far off, but a time that 64-bit nanoseconds hold
OPEN_END = "2199-12-31T23:59:59"


def _texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _lookup(key: str, table: dict) -> str:
    pairs = ", ".join(f"'{k}', {v!r}" for k, v in table.items())
    return f"try_element_at(map({pairs}), {key})"


def _let(name: str, value: str, body: str) -> str:
    """``body`` of a value that is computed once, however often it is used."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _case(*branches: tuple[str, str], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in branches) + f" ELSE {otherwise} END"


def _seconds(text: str) -> str:
    """Seconds of the day of ``h:mm`` or ``h:mm:ss``; null when there is no such time."""
    hour, minute, second = (f"try_cast(get(split({text}, ':'), {i}) AS int)" for i in range(3))
    second = f"coalesce({second}, 0)"
    return f"IF({hour} < 24 AND {minute} < 60 AND {second} < 60, {hour} * 3600 + {minute} * 60 + {second}, NULL)"


def _token(text: str) -> str:
    """What a token may be: ``kind`` and the number, clock, date or role that goes with it."""
    kind = _case(
        (f"{text} RLIKE r'^{_ISO}$'", "'iso'"),
        (rf"{text} RLIKE r'^\d+[/.]\d+[/.]\d+$' OR {text} IN ({_texts(_UNCLEAR)})", "'unclear'"),
        (rf"{text} RLIKE r'^\d{{1,2}}:' OR {text} IN ({_texts(_CLOCK_WORDS)})", "'clock'"),
        (rf"{text} RLIKE r'^\d{{4}}$'", "'year'"),
        (rf"{text} RLIKE r'^\d{{1,2}}(st|nd|rd|th)?$'", "'number'"),
        (rf"{text} RLIKE r'^[ap]\.?m\.?$'", "'half'"),
        (f"{text} RLIKE r'{_MONTH}'", "'month'"),
        (f"{text} IN ({_texts(_PRESENT)})", "'present'"),
        (f"{text} IN ({_texts(_LEADING)})", "'leading'"),
        (f"{text} = 'end'", "'end'"),
        (f"{text} IN ({_texts(_PASSED_OVER)})", "'over'"),
        otherwise="'other'",
    )
    month = f"CAST(array_position(array({_texts(_MONTHS)}), substring({text}, 1, 3)) AS int)"
    number = rf"try_cast(regexp_extract({text}, r'^(\d+)', 1) AS int)"
    year, month_of, day = (f"try_cast(get(split(substring_index({text}, 't', 1), '-'), {i}) AS int)" for i in range(3))
    clock = _seconds(f"nullif(regexp_extract({text}, r't(.+)$', 1), '')")
    fields = {
        "kind": "kind",
        "number": _case(("kind = 'month'", month), ("kind IN ('year', 'number')", number)),
        "clock": _case(("kind = 'clock'", f"coalesce({_lookup(text, _CLOCK_WORDS)}, {_seconds(text)})"), ("kind = 'iso'", clock)),
        **{name: f"IF(kind = 'iso', {value}, NULL)" for name, value in (("y", year), ("m", month_of), ("d", day))},
        "role": _lookup(text, _LEADING),
        "afternoon": f"startswith({text}, 'p')",
    }
    return _let("kind", kind, _struct(fields))


def _struct(fields: dict[str, str]) -> str:
    return f"named_struct({', '.join(f"'{name}', {value}" for name, value in fields.items())})"


def _part(**values: str) -> str:
    missing = {"boolean": "false"}
    return _struct({f: values.get(f) or f"CAST({missing.get(kind, 'NULL')} AS {kind})" for f, kind in _FIELDS.items()})


def _changed(part: str, **values: str) -> str:
    return _part(**{f: values.get(f, f"{part}.{f}") for f in _FIELDS})


def _after(parts="s.parts", role="CAST(NULL AS string)", end_of="false", number="CAST(NULL AS int)", near="true") -> str:
    """The next state; what led to a part is used up with it."""
    return _struct({"parts": parts, "role": role, "end_of": end_of, "number": number, "near": near, "kind": "t.kind"})


def _pushed(**values: str) -> str:
    return f"concat(s.parts, array({_part(role='s.role', end_of='s.end_of', **values)}))"


def _replaced(part: str) -> str:
    return f"concat(slice(s.parts, 1, n - 1), array({part}))"


def _step() -> str:
    """The state after token ``t``, from state ``s``, its number of parts ``n`` and the last of them."""
    near = "(s.near AND n > 0)"
    only_clock = f"({near} AND last.day IS NULL AND last.month IS NULL AND last.clock IS NOT NULL)"
    lacks_day = f"({near} AND last.month IS NOT NULL AND last.day IS NULL)"
    bare_day = "(n > 0 AND last.day IS NOT NULL AND last.month IS NULL AND last.year IS NULL)"

    def clocked(seconds: str) -> str:
        """A clock goes to the date beside it, else waits for one."""
        takes = f"({near} OR (s.role = 'from' AND last.day IS NOT NULL)) AND last.clock IS NULL"
        return _case(
            (f"{seconds} IS NULL", _after(near="s.near")),
            (takes, _after(_replaced(_changed("last", clock=seconds, role="coalesce(last.role, s.role)")))),
            otherwise=_after(_pushed(clock=seconds)),
        )

    hour = "IF(s.number BETWEEN 1 AND 12, (s.number % 12 + IF(t.afternoon, 12, 0)) * 3600, NULL)"
    again = "IF(last.clock BETWEEN 3600 AND 13 * 3600 - 1, last.clock % 43200 + IF(t.afternoon, 43200, 0), last.clock)"
    half = _case(
        ("s.number IS NOT NULL", clocked(hour)),
        (f"{near} AND s.kind = 'clock' AND last.clock IS NOT NULL", _after(_replaced(_changed("last", clock=again)))),
        otherwise=_after(near="false"),
    )
    month = _case(
        (f"s.number IS NOT NULL AND {only_clock}", _after(_replaced(_changed("last", day="s.number", month="t.number")))),
        (only_clock, _after(_replaced(_changed("last", month="t.number")))),
        ("s.number IS NOT NULL", _after(_pushed(day="s.number", month="t.number"))),
        otherwise=_after(_pushed(month="t.number")),
    )
    iso = _case(
        (f"{only_clock} AND t.clock IS NULL", _after(_replaced(_changed("last", day="t.d", month="t.m", year="t.y")))),
        otherwise=_after(_pushed(day="t.d", month="t.m", year="t.y", clock="t.clock")),
    )
    year = _case(
        (f"{near} AND last.year IS NULL AND (last.day IS NOT NULL OR last.month IS NOT NULL)", _after(_replaced(_changed("last", year="t.number")))),
        ("s.number IS NOT NULL AND s.role IN ('to', 'and')", _after(_pushed(day="s.number", year="t.number"))),
        otherwise=_after(near="false"),
    )
    number = _case(
        (lacks_day, _after(_replaced(_changed("last", day="t.number")))),
        otherwise=_after(role="s.role", end_of="s.end_of", number="t.number", near="s.near"),
    )
    # "up to", "and then": the word nearest to the date leads; a number before it may be a day
    leading = _after(
        f"IF(s.number IS NOT NULL AND t.role IN ('to', 'and'), {_pushed(day='s.number')}, s.parts)",
        role="IF(t.role = 'and' AND s.role IS NOT NULL AND s.kind = 'leading', s.role, t.role)", near="false",
    )
    chosen = _case(
        ("t.kind = 'iso'", iso), ("t.kind = 'month'", month), ("t.kind = 'year'", year), ("t.kind = 'number'", number),
        ("t.kind = 'half'", half), ("t.kind = 'clock'", clocked("t.clock")), ("t.kind = 'leading'", leading),
        ("t.kind = 'present' AND s.role = 'to'", _after(_pushed(present="true"), near="false")),
        ("t.kind = 'end'", _after(role="s.role", end_of="true", near="false")),
        ("t.kind = 'over'", _after(role="s.role", end_of="s.end_of", number="s.number", near="s.near")),
        ("t.kind = 'unclear'", _after(_pushed(unclear="true"))),
        otherwise=_after(f"IF(t.kind = 'other' AND {bare_day}, slice(s.parts, 1, n - 1), s.parts)", near="false"),
    )
    return _let("n", "size(s.parts)", _let("last", "get(s.parts, n - 1)", chosen))


def _nearest(field: str, later_first: str) -> str:
    """The field of part ``p`` at ``i`` of ``ps``, else of the nearest part that has it, in the order asked."""
    before = f"get(reverse(filter(slice(ps, 1, i), q -> q.{field} IS NOT NULL)), 0).{field}"
    later = f"get(filter(slice(ps, i + 2, size(ps)), q -> q.{field} IS NOT NULL), 0).{field}"
    return f"coalesce(p.{field}, IF({later_first}, coalesce({later}, {before}), coalesce({before}, {later})))"


def _completed(parts: str) -> str:
    """Every part with what it shares with its neighbours."""
    no_day = "(p.day IS NULL AND p.month IS NULL)"
    whole = _changed(
        "p",
        day=f"IF({no_day}, {_nearest('day', 'false')}, p.day)",
        # "27 to 29 Oct": the month follows; "Oct 27 to 29, 2024" and a clock alone: it came before
        month=_nearest("month", "p.day IS NOT NULL AND p.year IS NULL"),
        year=_nearest("year", f"NOT {no_day}"),
    )
    # "from 31 Dec to 2 Jan 2024" begins in the year before
    following = "get(found, i + 1)"
    earlier = f"get(ps, i).year IS NULL AND {following}.role = 'to' AND {following}.year = p.year AND p.month > {following}.month"
    ordered = _changed("p", year=f"IF({earlier}, p.year - 1, p.year)")
    return _let("ps", parts, _let("found", f"transform(ps, (p, i) -> {whole})", f"transform(found, (p, i) -> {ordered})"))


def _dated(parts: str) -> str:
    """Parts without months that are but a word; none at all where there is no date among them."""
    alone = f"p.month IN ({', '.join(map(str, _WORD_MONTHS))}) AND p.day IS NULL AND p.year IS NULL AND p.clock IS NULL"
    kept = f"filter({parts}, p -> NOT coalesce({alone}, false))"
    seen = "p.day IS NOT NULL OR p.month IS NOT NULL OR p.unclear OR p.present"
    return _let("kept", kept, f"IF(exists(kept, p -> {seen}), kept, CAST(array() AS {_PARTS}))")


def _text() -> str:
    """ISO date or date-time of part ``p``, moved past the day or second it excludes."""
    date = "concat_ws('-', lpad(CAST(p.year AS string), 4, '0'), lpad(CAST(p.month AS string), 2, '0'), lpad(CAST(p.day AS string), 2, '0'))"
    places = ("p.clock DIV 3600", "p.clock % 3600 DIV 60", "p.clock % 60")
    clock = "concat_ws(':', " + ", ".join(f"lpad(CAST({x} AS string), 2, '0')" for x in places) + ")"
    clock = _case(("p.clock IS NOT NULL", clock), ("p.end_of AND p.role = 'to'", "'23:59:00'"))
    iso = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss\")".format
    moved = _case(
        ("p.role = 'after' AND p.clock IS NULL", "CAST(date_add(CAST(moment AS date), 1) AS string)"),
        ("p.role = 'after'", iso("moment + INTERVAL '1' SECOND")),
        ("p.role = 'before'", iso("moment - INTERVAL '1' SECOND")),
    )
    plain = f"concat_ws('T', {date}, {clock})"
    moment = _let("moment", "try_cast(plain AS timestamp_ntz)", f"coalesce({moved}, plain)")
    return f"IF(p.present, '{OPEN_END}', {_let('plain', plain, moment)})"


def question_moments(question: str) -> Column:
    """``moments`` (an array of ``{text, role}``) and ``unclear`` of the question in a column of that name.

    ``role`` is the word that led to the moment: ``from, since, after, before, to, and`` or null; ``unclear``
    says that a date was seen but not understood. A null question has no moments.
    """
    tokens = f"transform(regexp_extract_all(lower({question}), r\"({_TOKEN})\", 1), x -> {_token('x')})"
    start = _struct({
        "parts": f"CAST(array() AS {_PARTS})", "role": "CAST(NULL AS string)", "end_of": "false", "number": "CAST(NULL AS int)",
        "near": "false", "kind": "''",
    })
    seen = f"aggregate(coalesce({tokens}, array()), {start}, (s, t) -> {_step()}, s -> s.parts)"
    missing = "exists(found, p -> p.unclear OR (NOT p.present AND (p.day IS NULL OR p.month IS NULL OR p.year IS NULL)))"
    moments = f"transform(found, p -> {_struct({'text': _text(), 'role': 'p.role'})})"
    return F.expr(_let("found", _completed(_dated(seen)), _struct({"moments": moments, "unclear": missing})))


def start_and_end(moments: Column) -> Column:
    """The texts that follow the name: start and end, or all moments where there are more than two.

    One moment is the start, or the end after "to", "until" or "before"; after "since" or
    "after" the window stays open. Two are start and end, also where the end is named first.
    """
    none = F.lit("None")
    first, second = F.get(moments, F.lit(0)), F.get(moments, F.lit(1))
    end_first = first["role"].isin("to", "before") & second["role"].isin("from", "since", "after")
    return (
        F.when(F.size(moments) == 0, F.array(none, none))
        .when((F.size(moments) == 1) & first["role"].isin("to", "before"), F.array(none, first["text"]))
        .when((F.size(moments) == 1) & first["role"].isin("since", "after"), F.array(first["text"], F.lit(OPEN_END)))
        .when(F.size(moments) == 1, F.array(first["text"], none))
        .when((F.size(moments) == 2) & F.coalesce(end_first, F.lit(False)), F.array(second["text"], first["text"]))
        .otherwise(F.transform(moments, lambda m: m["text"]))
    )
