"""Words of the statement grammar that are fixed from outside."""

# Words that PostgreSQL reserves (as names, or as type or function names).
RESERVED = frozenset(
    """
    all analyse analyze and any array as asc asymmetric authorization binary both case cast check collate collation column concurrently constraint create cross
    current_catalog current_date current_role current_schema current_time current_timestamp current_user default deferrable desc distinct do else end except false fetch for foreign
    freeze from full grant group having ilike in initially inner intersect into is isnull join lateral leading left like limit localtime localtimestamp natural not notnull null
    offset on only or order outer overlaps placing primary references returning right select session_user similar some symmetric system_user table tablesample then to trailing true
    union unique user using variadic verbose when where window with
    """.split()
)

# Functions whose result depends on more than their arguments.
NOT_IMMUTABLE = frozenset("now current_timestamp current_date current_time localtime localtimestamp random clock_timestamp statement_timestamp transaction_timestamp timeofday nextval currval current_user session_user gen_random_uuid".split())

# The least and greatest numbers of arguments of the scalar functions.
FUNCTIONS = {"STRPOS": (2, 2), "OCTET_LENGTH": (1, 1), "CHAR_LENGTH": (1, 1), "REGEXP_COUNT": (2, 2), "ABS": (1, 1), "CEIL": (1, 1), "FLOOR": (1, 1), "ROUND": (1, 2), "TRUNC": (1, 2), "DATE_TRUNC": (2, 2), "COALESCE": (1, 99), "NULLIF": (2, 2)}

# Aggregates that are computed, and those that are refused by name.
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
DEFERRED = ("BOOL_AND", "BOOL_OR", "BIT_AND", "BIT_OR", "ARRAY_AGG", "STRING_AGG", "JSONB_AGG")

# Units and fields of dates and times.
TRUNC_UNITS = ("microseconds", "milliseconds", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium")
DATE_FIELDS = ("year", "quarter", "month", "week", "day", "dow", "isodow", "doy", "isoyear", "decade", "century", "millennium", "epoch")
CLOCK_FIELDS = ("hour", "minute", "second", "milliseconds", "microseconds")

# Spellings of cast targets, and types that CAST(NULL AS ...) may name besides.
CAST_TARGETS = {"integer": "integer", "int": "integer", "int4": "integer", "bigint": "bigint", "int8": "bigint", "numeric": "numeric", "decimal": "numeric", "timestamp": "timestamp"}
NULL_TARGETS = ("smallint", "real", "double precision", "text", "boolean", "uuid", "date", "time", "timetz", "timestamptz", "interval", "bytea", "oid", "inet", "cidr", "macaddr", "macaddr8", "varbit", "jsonb")

# Types of typed literals.
LITERAL_TYPES = ("date", "timestamp", "bytea", "time", "timetz", "oid", "real", "double precision", "inet", "cidr", "macaddr", "macaddr8", "varbit", "jsonb")
