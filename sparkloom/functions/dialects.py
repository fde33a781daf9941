"""Function names of other dialects as Spark SQL, by template. {0}, {1} … are arguments and {*} is all of them."""

from __future__ import annotations

import re

#: Times of day are text, HH:mm:ss. Names that Spark has already, with the same meaning, are not listed.
TEMPLATES = {
    # arrays and strings
    "array_length": "nullif(size({0}), 0)",
    "array_cat": "concat({*})", "array_positions": "filter(transform({0}, (x, i) -> IF(x <=> {1}, i + 1, NULL)), x -> x IS NOT NULL)",
    "array_to_string": "array_join({*})", "string_to_array": "split({0}, concat('\\\\Q', {1}, '\\\\E'))", "regexp_split_to_array": "split({0}, {1})",
    "regexp_matches": "regexp_extract_all({0}, {1}, 0)", "starts_with": "startswith({*})",
    "format": "format_string({*})", "strpos": "instr({0}, {1})", "charindex": "locate({*})", "replicate": "repeat({*})",
    "stuff": "overlay({0} PLACING {3} FROM {1} FOR {2})", "quotename": "concat('[', replace({0}, ']', ']]'), ']')", "strcmp": "CAST(sign(CASE WHEN {0} < {1} THEN -1 WHEN {0} > {1} THEN 1 ELSE 0 END) AS INT)",
    "difference": "aggregate(zip_with(split(soundex({0}), ''), split(soundex({1}), ''), (a, b) -> IF(a <=> b, 1, 0)), 0, (s, x) -> s + x)",
    "space": "repeat(' ', {0})", "group_concat": "string_agg({0}, ',')", "listagg": "string_agg({*})", "xmlagg": "string_agg({0}, '')", "datalength": "octet_length({0})", "pg_column_size": "octet_length({0})",
    "mid": "substring({*})", "ucase": "upper({0})", "lcase": "lower({0})", "len": "length(rtrim({0}))", "truncate": "(sign({0}) * floor(abs({0}) * power(10, {1})) / power(10, {1}))",
    # dates
    "age": "({0} - {1})", "curtime": "date_format(current_timestamp(), 'HH:mm:ss')", "timediff": "({0} - {1})", "makedate": "date_add(make_date({0}, 1, 1), {1} - 1)", "maketime": "format_string('%02d:%02d:%02d', {0}, {1}, CAST({2} AS INT))",
    "datefromparts": "make_date({*})", "timefromparts": "format_string('%02d:%02d:%02d', {0}, {1}, {2})", "datetimefromparts": "make_timestamp({0}, {1}, {2}, {3}, {4}, {5})", "eomonth": "last_day({0})", "isdate": "IF(try_to_timestamp({0}) IS NOT NULL, 1, 0)",
    "sysdate": "current_timestamp()", "systimestamp": "current_timestamp()", "sysdatetime": "current_timestamp()", "sysdatetimeoffset": "current_timestamp()", "getdate": "current_timestamp()",
    "getutcdate": "to_utc_timestamp(current_timestamp(), current_timezone())", "sysutcdatetime": "to_utc_timestamp(current_timestamp(), current_timezone())", "clock_timestamp": "current_timestamp()", "statement_timestamp": "current_timestamp()",
    "to_timestamp_ntz_epoch": "CAST(timestamp_seconds({0}) AS TIMESTAMP_NTZ)", "months_between_whole": "CAST(months_between({0}, {1}) AS INT)",
    # JSON and XML
    "json_merge": "to_json(map_concat(map_filter(CAST(parse_json({0}) AS MAP<STRING, VARIANT>), (k, v) -> NOT array_contains(json_object_keys({1}), k)), CAST(parse_json({1}) AS MAP<STRING, VARIANT>)))",
    "jsonb_strip_nulls": "to_json(map_filter(CAST(parse_json({0}) AS MAP<STRING, VARIANT>), (k, v) -> NOT is_variant_null(v)))",
    "jsonb_typeof": "decode(regexp_extract(schema_of_variant(parse_json({0})), '^[A-Z]+', 0), 'OBJECT', 'object', 'ARRAY', 'array', 'STRING', 'string', 'BOOLEAN', 'boolean', 'VOID', 'null', 'number')",
    "json_type": "decode(regexp_extract(schema_of_variant(parse_json({0})), '^[A-Z]+', 0), 'BIGINT', 'INTEGER', 'VOID', 'NULL', 'DECIMAL', 'DOUBLE', regexp_extract(schema_of_variant(parse_json({0})), '^[A-Z]+', 0))",
    "json_extract": "get_json_object({0}, {1})", "json_value": "get_json_object({0}, {1})", "json_query": "get_json_object({0}, {1})", "json_exists": "(get_json_object({0}, {1}) IS NOT NULL)",
    "jsonb_extract_path_text": "get_json_object({0}, concat('$.', {1}))", "jsonb_path_exists": "(get_json_object({0}, {1}) IS NOT NULL)", "jsonb_path_query": "get_json_object({0}, {1})",
    "json_array": "to_json(array({*}))", "json_object": "to_json(map({*}))", "jsonb_build_array": "to_json(array({*}))", "jsonb_build_object": "to_json(map({*}))", "jsonb_object": "to_json(map_from_arrays({0}, {1}))",
    "jsonb_agg": "to_json(collect_list({0}))", "json_agg": "to_json(collect_list({0}))", "json_arrayagg": "to_json(collect_list({0}))", "jsonb_object_agg": "to_json(map_from_entries(collect_list(struct({0}, {1}))))", "json_objectagg": "to_json(map_from_entries(collect_list(struct({0}, {1}))))",
   
   
   
   
   
   
    "json_unquote": "coalesce(get_json_object(concat('[', {0}, ']'), '$[0]'), {0})", "json_quote": "substring(to_json(array({0})), 2, length(to_json(array({0}))) - 2)",
    "json_valid": "(try_parse_json({0}) IS NOT NULL)", "isjson": "IF(try_parse_json({0}) IS NOT NULL, 1, 0)", "json_keys": "json_object_keys({0})", "jsonb_object_keys": "explode(json_object_keys({0}))", "json_length": "coalesce(json_array_length({0}), size(json_object_keys({0})))", "jsonb_array_length": "json_array_length({0})",
    "xmlexists": "xpath_boolean({1}, {0})", "xmlquery": "xpath({1}, {0})", "extractvalue": "xpath_string({0}, {1})",
    # conversion, conditions, identity
    "to_clob": "CAST({0} AS STRING)", "to_nclob": "CAST({0} AS STRING)", "to_blob": "to_binary({0}, 'utf-8')", "isnull_else": "coalesce({0}, {1})", "iif": "IF({*})", "choose": "elt({*})", "decode_case": "decode({*})", "lnnvl": "(NOT coalesce({0}, FALSE))",
    "num_nonnulls": "size(filter(array({*}), x -> x IS NOT NULL))", "num_nulls": "size(filter(array({*}), x -> x IS NULL))", "db_name": "current_database()", "database": "current_database()", "schema_name": "current_schema()", "user_name": "current_user()", "current_schemas": "array(current_schema())",
    "newid": "uuid()", "newsequentialid": "uuid()", "gen_random_uuid": "uuid()", "sys_guid": "uuid()",
    # aggregates
    "stdev": "stddev_samp({0})", "stdevp": "stddev_pop({0})", "var": "var_samp({0})", "varp": "var_pop({0})", "checksum_agg": "bit_xor(hash({0}))", "collect": "collect_list({0})", "count_big": "count({0})", "approx_count": "approx_count_distinct({0})",
    # ranges: structs of lo, hi, lo_in, hi_in
    "numrange": "named_struct('lo', {0}, 'hi', {1}, 'lo_in', TRUE, 'hi_in', FALSE)", "int4range": "named_struct('lo', {0}, 'hi', {1}, 'lo_in', TRUE, 'hi_in', FALSE)", "int8range": "named_struct('lo', {0}, 'hi', {1}, 'lo_in', TRUE, 'hi_in', FALSE)",
    "daterange": "named_struct('lo', {0}, 'hi', {1}, 'lo_in', TRUE, 'hi_in', FALSE)", "tsrange": "named_struct('lo', {0}, 'hi', {1}, 'lo_in', TRUE, 'hi_in', FALSE)", "tstzrange": "named_struct('lo', {0}, 'hi', {1}, 'lo_in', TRUE, 'hi_in', FALSE)",
    "isempty": "({0}.lo > {0}.hi OR ({0}.lo = {0}.hi AND NOT ({0}.lo_in AND {0}.hi_in)))", "lower_inc": "({0}.lo_in AND {0}.lo IS NOT NULL)", "upper_inc": "({0}.hi_in AND {0}.hi IS NOT NULL)", "lower_inf": "({0}.lo IS NULL)", "upper_inf": "({0}.hi IS NULL)",
    # vectors and trigrams
    "l2_distance": "sqrt(aggregate(zip_with({0}, {1}, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))", "inner_product": "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, v) -> s + v)",
    "l1_distance": "aggregate(zip_with({0}, {1}, (x, y) -> abs(x - y)), 0D, (s, v) -> s + v)", "vector_dims": "size({0})", "vector_norm": "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))",
    "cosine_distance": "(1 - aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, v) -> s + v) / (sqrt(aggregate({0}, 0D, (s, x) -> s + x * x)) * sqrt(aggregate({1}, 0D, (s, x) -> s + x * x))))",
    "show_trgm": "array_sort(array_distinct(transform(sequence(1, length({0}) + 1), i -> substring(concat('  ', lower({0}), ' '), i, 3))))",
}


def _literal(argument: str, name: str) -> str:
    """The text of a literal argument, which decides how the call is written."""
    found = re.fullmatch(r"\s*'((?:[^']|'')*)'\s*", argument)
    if not found:
        raise ValueError(f"{name} needs a literal here, not {argument}")
    return found[1].replace("''", "'")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _changed(of: str, keys: list[str], value: str | None, how: str, depth: int = 0) -> str:
    key, k, v = _quoted(keys[0]), f"k{depth}", f"v{depth}"
    rest = f"map_filter({of}, ({k}, {v}) -> {k} != {key})"
    if len(keys) == 1:
        if how == "remove":
            return rest
        new, has = f"map_concat({rest}, map({key}, {value}))", f"map_contains_key({of}, {key})"
        return {"set": new, "insert": f"IF({has}, {of}, {new})", "replace": f"IF({has}, {new}, {of})"}[how]
    inner = f"try_variant_get({of}[{key}], '$', 'MAP<STRING, VARIANT>')"
    return f"IF({inner} IS NULL, {of}, map_concat({rest}, map({key}, parse_json(to_json({_changed(inner, keys[1:], value, how, depth + 1)})))))"


def json_changed(document: str, keys: list[str], value: str | None, how: str) -> str:
    """SQL for a JSON object (as text) with the member at a path of keys set, inserted, replaced or removed.

    value is SQL of a VARIANT. All other values keep their types and nesting. A path through what is no object changes nothing.
    """
    return f"to_json({_changed(f'CAST(parse_json({document}) AS MAP<STRING, VARIANT>)', keys, value, how)})"


def _dollar_path(argument: str, name: str) -> list[str]:
    path = _literal(argument, name)
    if not re.fullmatch(r"\$(\.[^.\[\]*]+)+", path):
        raise ValueError(f"{name} takes a path of members, such as $.a.b, not {path}")
    return path[2:].split(".")


def _json_call(how: str, name: str):
    return lambda a: json_changed(a[0], _dollar_path(a[1], name), f"CAST({a[2]} AS VARIANT)" if how != "remove" else None, how)


def _groups(arguments: list[str]) -> str:
    pattern = _literal(arguments[1], "regexp_match")
    n = re.compile(pattern).groups
    parts = ", ".join(f"regexp_extract({arguments[0]}, {_quoted(pattern)}, {k})" for k in (range(1, n + 1) if n else [0]))
    return f"IF({arguments[0]} RLIKE {_quoted(pattern)}, array({parts}), NULL)"


def _like_place(arguments: list[str]) -> str:
    """PATINDEX: a LIKE pattern, its place in the text from 1, or 0."""
    pattern = _literal(arguments[0], "patindex")
    body = re.sub(r"%+$", "", pattern)
    inner = "".join({"%": ".*", "_": "."}.get(c, c if c in "[]^-" else re.escape(c)) for c in body.lstrip("%"))
    return f"regexp_instr({arguments[1]}, {_quoted(('' if pattern.startswith('%') else '^') + inner + ('' if pattern.endswith('%') else '$'))})"


#: The codes of a date format of one dialect and those that Spark has for them.
DATE_CODES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%h": "hh", "%i": "mm", "%s": "ss", "%S": "ss", "%p": "a", "%b": "MMM", "%M": "MMMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%%": "%"}


def _date_format(argument: str) -> str:
    return _quoted(re.sub(r"%.", lambda m: DATE_CODES[m[0]], _literal(argument, "str_to_date")))


#: Calls whose Spark SQL depends on a literal argument.
BUILDERS = {
    **{n: _json_call(how, n) for n, how in (("json_set", "set"), ("json_modify", "set"), ("json_insert", "insert"), ("json_replace", "replace"), ("json_remove", "remove"))},
    "jsonb_set": lambda a: json_changed(a[0], _literal(a[1], "jsonb_set").strip("{}").split(","), f"parse_json({a[2]})", "set"),
    "regexp_match": _groups,
    "patindex": _like_place,
    "str_to_date": lambda a: f"to_timestamp({a[0]}, {_date_format(a[1])})",
}


def call(name: str, arguments: list[str]) -> str | None:
    """Spark SQL for a call, or None where Spark's own function of that name is meant."""
    builder, template = BUILDERS.get(name.lower()), TEMPLATES.get(name.lower())
    if builder is None and template is None:
        return None
    try:
        return builder(arguments) if builder else re.sub(r"\{(\*|\d)\}", lambda m: ", ".join(arguments) if m[1] == "*" else arguments[int(m[1])], template)
    except IndexError:
        raise ValueError(f"{name} needs more than {len(arguments)} arguments") from None
