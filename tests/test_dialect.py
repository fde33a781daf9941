from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest

from sparkloom.plans import dialect


@pytest.fixture(scope="module", autouse=True)
def tables(spark):
    spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 7), (4, "b", 1)], "k int, g string, v int").createOrReplaceTempView("d_rows")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("TABLE d_rows", [(1, "a", 5), (2, "a", 7), (3, "b", 7), (4, "b", 1)]),
        ("SELECT k FROM d_rows WHERE g ~ '^a' AND g !~* 'B'", [(1,), (2,)]),
        ("SELECT k FROM d_rows WHERE g SIMILAR TO '(b|c)%'", [(3,), (4,)]),
        ("SELECT k FROM d_rows WHERE g ^@ 'b'", [(3,), (4,)]),
        ("SELECT k, g FROM d_rows QUALIFY row_number() OVER (PARTITION BY g ORDER BY v DESC) = 1", [(2, "a"), (3, "b")]),
        ("SELECT DISTINCT ON (g) g, k, v FROM d_rows ORDER BY g, v", [("a", 1, 5), ("b", 4, 1)]),
        ("SELECT k FROM d_rows ORDER BY k DESC FETCH FIRST 2 ROWS ONLY", [(3,), (4,)]),
        ("SELECT k, v FROM d_rows ORDER BY v DESC FETCH FIRST 1 ROW WITH TIES", [(2, 7), (3, 7)]),
        ("SELECT n FROM generate_series(2, 6, 2) AS t(n)", [(2,), (4,), (6,)]),
        ("SELECT e, o FROM UNNEST(array(7, 8)) WITH ORDINALITY AS t(e, o)", [(7, 1), (8, 2)]),
        ("SELECT k, e FROM d_rows, UNNEST(array(k, v)) AS t(e) WHERE k = 1", [(1, 1), (1, 5)]),
        ("SELECT array_to_string(string_to_array('a.b', '.'), '-') AS x", [("a-b",)]),
        ("SELECT strcmp('a', 'b') AS a, quotename('x]') AS b, json_value('{\"p\": 3}', '$.p') AS c, makedate(2024, 60) = DATE'2024-02-29' AS d", [(-1, "[x]]]", "3", True)]),
        ("SELECT json_length('[1, 2]') AS a, json_length('{\"p\": 3}') AS b, json_valid('{') AS c, stuff('abcdef', 2, 3, 'X') AS d", [(2, 1, False, "aXef")]),
        ("SELECT g, group_concat(DISTINCT g) AS x, count_big(*) AS n FROM d_rows GROUP BY g", [("a", "a", 2), ("b", "b", 2)]),
        ("SELECT round(l2_distance(array(1D, 2D), array(1D, 4D)), 3) AS d, 'it''s ~ here' AS s", [(2.0, "it's ~ here")]),
        ("SELECT truncate(-1.57, 1) AS t, lower_inf(numrange(NULL, 3)) AS i, num_nulls(1, NULL, 2) AS n", [(-1.5, True, 1)]),
    ],
)
def test_translated(spark, text, want):
    got = sorted(tuple(float(x) if str(type(x)).endswith("Decimal'>") else x for x in r) for r in dialect.sql(spark, text).collect())
    assert got == sorted(want)


def test_too_few_arguments():
    with pytest.raises(ValueError, match="more than 1"):
        dialect.translate("SELECT strcmp('a')")


A_JSON, X_ML = """'{"a":1,"b":{"c":"x"}}'""", "'<a><b>1</b></a>'"
NOT_NULL = object()
AGGREGATES = {"jsonb_agg", "json_agg", "json_arrayagg", "jsonb_object_agg", "json_objectagg", "stdev", "stdevp", "var", "varp", "checksum_agg", "collect", "count_big", "approx_count", "group_concat", "listagg", "xmlagg"}
#: Of each function a call's arguments and what it must give; aggregates are over the values 1, 2 and 4.
CALLS = {
    "array_length": ("array(1, 2)", 2), "array_cat": ("array(1), array(2)", [1, 2]), "array_positions": ("array(5, 6, 5), 5", [1, 3]), "array_to_string": ("array('a', 'b'), '-'", "a-b"),
    "string_to_array": ("'a.b', '.'", ["a", "b"]), "regexp_split_to_array": ("'a1b', '[0-9]'", ["a", "b"]), "regexp_match": ("'abcd', 'a(b)(c)'", ["b", "c"]), "regexp_matches": ("'a1b2', '[0-9]'", ["1", "2"]),
    "starts_with": ("'abc', 'ab'", True), "format": ("'%s-%s', 'a', 'b'", "a-b"), "strpos": ("'abc', 'c'", 3), "charindex": ("'c', 'abc'", 3), "patindex": ("'%b_d%', 'abcd'", 2), "replicate": ("'ab', 2", "abab"),
    "stuff": ("'abcdef', 2, 3, 'X'", "aXef"), "quotename": ("'x]'", "[x]]]"), "strcmp": ("'a', 'b'", -1), "difference": ("'Smith', 'Smythe'", 4), "space": ("2", "  "), "datalength": ("'é'", 2), "pg_column_size": ("'é'", 2),
    "mid": ("'abcdef', 2, 3", "bcd"), "ucase": ("'a'", "A"), "lcase": ("'A'", "a"), "len": ("'ab  '", 2), "truncate": ("-1.57D, 1", -1.5),
    "age": ("DATE'2024-03-01', DATE'2024-02-01'", timedelta(29)), "str_to_date": ("'03/02/2024 05', '%d/%m/%Y %H'", datetime(2024, 2, 3, 5)), "curtime": ("", NOT_NULL), "timediff": ("TIMESTAMP'2024-01-01 02:00:00', TIMESTAMP'2024-01-01 01:00:00'", timedelta(hours=1)),
    "makedate": ("2024, 60", date(2024, 2, 29)), "maketime": ("1, 2, 3", "01:02:03"), "datefromparts": ("2024, 2, 3", date(2024, 2, 3)), "timefromparts": ("1, 2, 3, 0, 0", "01:02:03"), "datetimefromparts": ("2024, 1, 2, 3, 4, 5, 0", datetime(2024, 1, 2, 3, 4, 5)),
    "eomonth": ("DATE'2024-02-03'", date(2024, 2, 29)), "isdate": ("'x'", 0), **dict.fromkeys(("sysdate", "systimestamp", "sysdatetime", "sysdatetimeoffset", "getdate", "getutcdate", "sysutcdatetime", "clock_timestamp", "statement_timestamp"), ("", NOT_NULL)),
    "to_timestamp_ntz_epoch": ("0", datetime(1970, 1, 1)), "months_between_whole": ("DATE'2024-03-01', DATE'2024-01-15'", 1),
    **dict.fromkeys(("json_extract", "json_value", "jsonb_path_query"), (f"{A_JSON}, '$.b.c'", "x")), "json_query": (f"{A_JSON}, '$.b'", '{"c":"x"}'), **dict.fromkeys(("json_exists", "jsonb_path_exists"), (f"{A_JSON}, '$.b.c'", True)), "jsonb_extract_path_text": (f"{A_JSON}, 'a'", "1"),
    **dict.fromkeys(("json_array", "jsonb_build_array"), ("1, 2", "[1,2]")), **dict.fromkeys(("json_object", "jsonb_build_object"), ("'a', 1", '{"a":1}')), "jsonb_object": ("array('a'), array('x')", '{"a":"x"}'),
    **dict.fromkeys(("jsonb_agg", "json_agg", "json_arrayagg"), ("x", "[1,2,4]")), **dict.fromkeys(("jsonb_object_agg", "json_objectagg"), ("CAST(x AS STRING), x", '{"1":1,"2":2,"4":4}')),
    "jsonb_strip_nulls": ("""'{"a":1,"b":null}'""", '{"a":1}'), "jsonb_set": (A_JSON + ", '{b,c}', '[2]'", '{"a":1,"b":{"c":[2]}}'), "json_set": (f"{A_JSON}, '$.b.d', 2", '{"a":1,"b":{"c":"x","d":2}}'), "json_modify": (f"{A_JSON}, '$.a', 'y'", '{"b":{"c":"x"},"a":"y"}'),
    "json_insert": (f"{A_JSON}, '$.a', 5", '{"a":1,"b":{"c":"x"}}'), "json_replace": (f"{A_JSON}, '$.z', 5", '{"a":1,"b":{"c":"x"}}'), "json_remove": (f"{A_JSON}, '$.b.c'", '{"a":1,"b":{}}'), "json_merge": (f"{A_JSON}, " + """'{"a":[1]}'""", '{"b":{"c":"x"},"a":[1]}'),
    "json_unquote": ("""'"x"'""", "x"), "json_quote": ("'x'", '"x"'), "jsonb_typeof": (A_JSON, "object"), "json_type": ("'3'", "INTEGER"), "json_valid": (A_JSON, True), "isjson": ("'{'", 0), "json_keys": (A_JSON, ["a", "b"]), "jsonb_object_keys": ("""'{"a":1}'""", "a"),
    "json_length": (A_JSON, 2), "jsonb_array_length": ("'[1, 2]'", 2), "xmlexists": (f"'/a/b', {X_ML}", True), "xmlquery": (f"'/a/b/text()', {X_ML}", ["1"]), "extractvalue": (f"{X_ML}, '/a/b'", "1"),
    "to_clob": ("1", "1"), "to_nclob": ("1", "1"), "to_blob": ("'a'", b"a"), "isnull_else": ("NULL, 1", 1), "iif": ("1 > 0, 'a', 'b'", "a"), "choose": ("2, 'a', 'b'", "b"), "decode_case": ("1, 1, 'x', 'y'", "x"), "lnnvl": ("1 = 2", True),
    "num_nonnulls": ("1, NULL", 1), "num_nulls": ("1, NULL", 1), **dict.fromkeys(("db_name", "database", "schema_name", "user_name", "current_schemas", "newid", "newsequentialid", "gen_random_uuid", "sys_guid"), ("", NOT_NULL)),
    "stdev": ("x", 1.527525), "stdevp": ("x", 1.247219), "var": ("x", 2.333333), "varp": ("x", 1.555556), "checksum_agg": ("x", NOT_NULL), "collect": ("x", [1, 2, 4]), "count_big": ("x", 3), "approx_count": ("x", 3),
    "group_concat": ("CAST(x AS STRING)", "1,2,4"), "listagg": ("CAST(x AS STRING), '-'", "1-2-4"), "xmlagg": ("CAST(x AS STRING)", "124"),
    **dict.fromkeys(("numrange", "int4range", "int8range"), ("1, 3", (1, 3, True, False))), "daterange": ("DATE'2024-01-01', NULL", (date(2024, 1, 1), None, True, False)), **dict.fromkeys(("tsrange", "tstzrange"), ("NULL, NULL", (None, None, True, False))),
    "isempty": ("numrange(1, 1)", True), "lower_inc": ("numrange(1, 3)", True), "upper_inc": ("numrange(1, 3)", False), "lower_inf": ("numrange(1, 3)", False), "upper_inf": ("numrange(1, NULL)", True),
    "l2_distance": ("array(1D, 2D), array(1D, 4D)", 2.0), "inner_product": ("array(1D, 2D), array(3D, 4D)", 11.0), "l1_distance": ("array(1D, 2D), array(3D, 4D)", 4.0), "vector_dims": ("array(1D, 2D)", 2), "vector_norm": ("array(3D, 4D)", 5.0),
    "cosine_distance": ("array(1D, 0D), array(0D, 1D)", 1.0), "show_trgm": ("'ab'", ["  a", " ab", "ab "]),
}


def test_every_function_gives_what_its_dialect_says(spark):
    from sparkloom.functions.dialects import BUILDERS, TEMPLATES

    assert set(CALLS) == set(TEMPLATES) | set(BUILDERS)
    wrong = {}
    for name, (arguments, want) in CALLS.items():
        rows = "(SELECT explode(array(1, 2, 4)) AS x)" if name in AGGREGATES else "(SELECT 1 AS one)"
        try:
            got = dialect.sql(spark, f"SELECT {name}({arguments}) AS r FROM {rows}").first()[0]
        except Exception as e:
            wrong[name] = str(e)[:200]
            continue
        got = round(got, 6) if isinstance(got, float) else tuple(got) if hasattr(got, "asDict") else bytes(got) if isinstance(got, bytearray) else got
        if (got is None) if want is NOT_NULL else got != want:
            wrong[name] = got
    assert not wrong


def test_arguments_are_put_in_once(spark):
    assert [r[0] for r in dialect.sql(spark, "SELECT array_to_string(array('{1}', 'b'), '{0}')").collect()] == ["{1}{0}b"]
    assert dialect.sql(spark, "SELECT regexp_match('x', 'a(b)') AS a, array_length(array()) AS b").first() == (None, None)
    with pytest.raises(ValueError, match="literal"):
        dialect.translate("SELECT json_set(a, b, 1)")
