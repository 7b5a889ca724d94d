"""Scalar functions: each takes lowered arguments (sql, kind) and gives (sql, kind).

Kinds are int, float, str, bool, time, date, bin and None for unknown. With compat, strings are read as the two-valued
dialect reads them: NULL is an empty string to string functions, and lengths count bytes.
"""

from __future__ import annotations

from collections.abc import Callable

Arg = tuple[str, str | None]


class BadCall(ValueError):
    """An unknown function, or wrong arguments."""


def integer(sql: str) -> str:
    """An argument that Spark wants as a 32-bit integer."""
    return sql[:-1] if sql.endswith("L") and sql[:-1].lstrip("-").isdigit() else f"cast({sql} as int)"


def text(arg: Arg) -> str:
    return arg[0] if arg[1] == "str" else f"cast({arg[0]} as string)"


def _text(arg: Arg, compat: bool) -> str:
    return f"coalesce({text(arg)}, '')" if compat else text(arg)


def _string(name: str) -> Callable:
    return lambda a, compat: (f"{name}({_text(a[0], compat)})", "str")


def _trim(a: list[Arg], compat: bool) -> Arg:
    if not compat:
        return f"trim({text(a[0])})", "str"
    return f"regexp_replace(regexp_replace({_text(a[0], True)}, '(?U)^\\\\s+', ''), '(?U)\\\\s+$', '')", "str"


def _len(a: list[Arg], compat: bool) -> Arg:
    if compat:
        return f"coalesce(cast(octet_length({text(a[0])}) as bigint), 0L)", "int"
    return f"cast(length({text(a[0])}) as bigint)", "int"


def _datalen(a: list[Arg], compat: bool) -> Arg:
    size = f"cast(octet_length({a[0][0] if a[0][1] == 'bin' else text(a[0])}) as bigint)"
    return (f"coalesce({size}, 0L)" if compat else size), "int"


def _substring(a: list[Arg], compat: bool) -> Arg:
    start, length = integer(a[1][0]), integer(a[2][0])
    return f"substring({_text(a[0], compat)}, greatest({start}, 1), greatest(0, {length} + least({start}, 1) - 1))", "str"


def _first_kind(name: str) -> Callable:
    return lambda a, compat: (f"{name}({', '.join(x[0] for x in a)})", next((x[1] for x in a if x[1]), None))


def _part(name: str) -> Callable:
    return lambda a, compat: (f"cast({name}({a[0][0]}) as bigint)", "int")


def _now(a: list[Arg], compat: bool) -> Arg:
    return "current_timestamp()", "time"


def _float(name: str) -> Callable:
    return lambda a, compat: (f"{name}({', '.join(f'cast({x[0]} as double)' for x in a)})", "float")


def _same(name: str) -> Callable:
    return lambda a, compat: (f"{name}({a[0][0]})", a[0][1])


def _round(a: list[Arg], compat: bool) -> Arg:
    return f"round({a[0][0]}, {integer(a[1][0]) if len(a) > 1 else 0})", a[0][1]


_PARTS = {
    "YEAR": "year", "YY": "year", "YYYY": "year", "QUARTER": "quarter", "QQ": "quarter", "Q": "quarter", "MONTH": "month", "MM": "month", "M": "month",
    "DAY": "day", "DD": "day", "D": "day", "WEEK": "week", "WK": "week", "HOUR": "hour", "HH": "hour", "MINUTE": "minute", "MI": "minute", "N": "minute",
    "SECOND": "second", "SS": "second", "S": "second", "DAYOFYEAR": "doy", "DY": "doy",
}


def _unit(arg: Arg) -> str:
    unit = _PARTS.get(arg[0].strip("`'").upper())
    if unit is None:
        raise BadCall(f"unknown date part {arg[0]}")
    return unit


def _datepart(a: list[Arg], compat: bool) -> Arg:
    return f"cast(extract({_unit(a[0])} from {a[1][0]}) as bigint)", "int"


def _dateadd(a: list[Arg], compat: bool) -> Arg:
    return f"timestampadd({_unit(a[0]).replace('doy', 'day')}, {integer(a[1][0])}, cast({a[2][0]} as timestamp))", "time"


def _datediff(a: list[Arg], compat: bool) -> Arg:
    unit = _unit(a[0]).replace("doy", "day")  # boundaries that are passed
    first, second = (f"date_trunc('{unit}', cast({x[0]} as timestamp))" for x in a[1:3])
    return f"timestampdiff({unit}, {first}, {second})", "int"


def _stuff(a: list[Arg], compat: bool) -> Arg:
    return f"overlay({text(a[0])} placing {text(a[3])} from {integer(a[1][0])} for {integer(a[2][0])})", "str"


def _charindex(a: list[Arg], compat: bool) -> Arg:
    start = f", {integer(a[2][0])}" if len(a) > 2 else ""
    return f"cast(locate({text(a[0])}, {text(a[1])}{start}) as bigint)", "int"


def _format(a: list[Arg], compat: bool) -> Arg:
    """Dates by letters, numbers by N or F and decimals."""
    form = a[1][0].strip("'")
    if a[0][1] in ("time", "date"):
        return f"date_format({a[0][0]}, {a[1][0]})", "str"
    if a[0][1] in ("int", "float", "dec") and form[:1].upper() in ("N", "F") and (form[1:] or "2").isdigit():
        digits = int(form[1:] or 2)
        shown = f"format_number({a[0][0]}, {digits})"
        return (shown if form[0].upper() == "N" else f"replace({shown}, ',', '')"), "str"
    raise BadCall(f"FORMAT doesn't know {form}")


def _choose(a: list[Arg], compat: bool) -> Arg:
    tests = " ".join(f"WHEN {i} THEN {x[0]}" for i, x in enumerate(a[1:], 1))
    return f"CASE {a[0][0]} {tests} END", a[1][1]


#: name: (least arguments, most or None for any, how)
SCALAR: dict[str, tuple[int, int | None, Callable]] = {
    "LEN": (1, 1, _len), "DATALEN": (1, 1, _datalen), "DATALENGTH": (1, 1, _datalen),
    "UPPER": (1, 1, _string("upper")), "LOWER": (1, 1, _string("lower")), "LTRIM": (1, 1, _string("ltrim")), "RTRIM": (1, 1, _string("rtrim")),
    "TRIM": (1, 1, _trim), "ISNULL": (1, None, _first_kind("coalesce")), "COALESCE": (1, None, _first_kind("coalesce")),
    "NULLIF": (2, 2, lambda a, c: (f"nullif({a[0][0]}, {a[1][0]})", a[0][1])), "ABS": (1, 1, _same("abs")),
    "CONCAT": (1, None, lambda a, c: (f"concat_ws('', {', '.join(text(x) for x in a)})", "str")),
    "REPLACE": (3, 3, lambda a, c: (f"replace({_text(a[0], c)}, {text(a[1])}, {text(a[2])})", "str")), "SUBSTRING": (3, 3, _substring),
    "YEAR": (1, 1, _part("year")), "MONTH": (1, 1, _part("month")), "DAY": (1, 1, _part("day")),
    "GETDATE": (0, 0, _now), "GETUTCDATE": (0, 0, _now), "SYSDATETIME": (0, 0, _now), "SYSUTCDATETIME": (0, 0, _now), "CURRENT_TIMESTAMP": (0, 0, _now),
    "HAS_DBACCESS": (1, 1, lambda a, c: ("1L", "int")), "SCHEMA_NAME": (0, 1, lambda a, c: ("'dbo'", "str")), "SCHEMA_ID": (0, 1, lambda a, c: ("1L", "int")),
    "QUOTENAME": (1, 1, lambda a, c: (f"concat('[', replace({text(a[0])}, ']', ']]'), ']')", "str")),
    # More than the dialect asks for.
    "FLOOR": (1, 1, _same("floor")), "CEILING": (1, 1, _same("ceil")), "ROUND": (1, 2, _round), "SIGN": (1, 1, _same("sign")),
    "POWER": (2, 2, _float("power")), "SQRT": (1, 1, _float("sqrt")), "SQUARE": (1, 1, lambda a, c: (f"power(cast({a[0][0]} as double), 2)", "float")),
    "EXP": (1, 1, _float("exp")), "LOG": (1, 1, _float("ln")), "LOG10": (1, 1, _float("log10")), "PI": (0, 0, lambda a, c: ("pi()", "float")),
    "SIN": (1, 1, _float("sin")), "COS": (1, 1, _float("cos")), "TAN": (1, 1, _float("tan")), "ATN2": (2, 2, _float("atan2")),
    "LEFT": (2, 2, lambda a, c: (f"left({text(a[0])}, {integer(a[1][0])})", "str")), "RIGHT": (2, 2, lambda a, c: (f"right({text(a[0])}, {integer(a[1][0])})", "str")),
    "REVERSE": (1, 1, _string("reverse")), "REPLICATE": (2, 2, lambda a, c: (f"repeat({text(a[0])}, {integer(a[1][0])})", "str")),
    "SPACE": (1, 1, lambda a, c: (f"space({integer(a[0][0])})", "str")), "CHARINDEX": (2, 3, _charindex), "STUFF": (4, 4, _stuff),
    "ASCII": (1, 1, lambda a, c: (f"cast(ascii({text(a[0])}) as bigint)", "int")), "CHAR": (1, 1, lambda a, c: (f"char({a[0][0]})", "str")),
    "CONCAT_WS": (2, None, lambda a, c: (f"concat_ws({', '.join(text(x) for x in a)})", "str")),
    "DATEPART": (2, 2, _datepart), "DATEADD": (3, 3, _dateadd), "DATEDIFF": (3, 3, _datediff),
    "DATEFROMPARTS": (3, 3, lambda a, c: (f"make_date({', '.join(integer(x[0]) for x in a)})", "date")), "EOMONTH": (1, 1, lambda a, c: (f"last_day({a[0][0]})", "date")),
    "IIF": (3, 3, lambda a, c: (f"if({a[0][0]}, {a[1][0]}, {a[2][0]})", a[1][1])), "CHOOSE": (2, None, _choose),
    "FORMAT": (2, 2, _format), "NEWID": (0, 0, lambda a, c: ("uuid()", "str")), "JSON_VALUE": (2, 2, lambda a, c: (f"get_json_object({text(a[0])}, {text(a[1])})", "str")),
    "GROUPING": (1, 1, lambda a, c: (f"cast(grouping({a[0][0]}) as bigint)", "int")), "GROUPING_ID": (0, None, lambda a, c: (f"grouping_id({', '.join(x[0] for x in a)})", "int")),
    "GREATEST": (2, None, _first_kind("greatest")), "LEAST": (2, None, _first_kind("least")),
}

#: The first argument of these is a date part, not a column.
DATE_PART = frozenset(["DATEPART", "DATEADD", "DATEDIFF"])

AGGREGATES = frozenset("COUNT COUNT_BIG SUM AVG MIN MAX STDEV STDEVP VAR VARP STRING_AGG APPROX_COUNT_DISTINCT".split())
RANKING = frozenset("ROW_NUMBER RANK DENSE_RANK NTILE LAG LEAD FIRST_VALUE LAST_VALUE PERCENT_RANK CUME_DIST".split())


def scalar(name: str, args: list[Arg], compat: bool) -> Arg:
    if name not in SCALAR:
        raise BadCall(f"unknown function {name}")
    least, most, how = SCALAR[name]
    if len(args) < least or (most is not None and len(args) > most):
        raise BadCall(f"{name} takes {least}{'' if most == least else f' to {most}' if most else ' or more'} arguments, not {len(args)}")
    return how(args, compat)


def aggregate(name: str, args: list[Arg], star: bool, distinct: bool, compat: bool, within: str | None = None) -> Arg:
    """SUM and AVG are double, but for decimals that are a kind of their own."""
    if name in ("COUNT", "COUNT_BIG"):
        if star:
            return "count(*)", "int"
        return f"count({'DISTINCT ' * distinct}{args[0][0]})", "int"
    if name == "STRING_AGG":
        order = f" WITHIN GROUP (ORDER BY {within})" if within else ""
        return f"listagg({'DISTINCT ' * distinct}{text(args[0])}, {args[1][0]}){order}", "str"
    if len(args) != 1:
        raise BadCall(f"{name} takes one argument")
    sql, kind = args[0]
    if name in ("SUM", "AVG"):
        if kind == "dec":
            found = f"{name.lower()}({'DISTINCT ' * distinct}{sql})"
            return (f"coalesce({found}, 0)" if compat and name == "SUM" else found), "dec"
        found = f"{name.lower()}({'DISTINCT ' * distinct}cast({sql} as double))"
        return (f"coalesce({found}, 0D)" if compat and name == "SUM" else found), "float"
    if name in ("MIN", "MAX"):
        return f"{name.lower()}({sql})", kind
    if name == "APPROX_COUNT_DISTINCT":
        return f"approx_count_distinct({sql})", "int"
    spark = {"STDEV": "stddev_samp", "STDEVP": "stddev_pop", "VAR": "var_samp", "VARP": "var_pop"}[name]
    return f"{spark}(cast({sql} as double))", "float"
