"""Column expressions, case by case."""

import pytest
from pyspark.sql import functions as F

from tributary.functions import expressions as X
from tributary.functions import paths, templates


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([values], schema).select(make(*[F.col(n) for n in names]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "path, layer, group",
    [
        ("models/staging/x.sql", "staging", None),
        ("models/retail/staging/x.sql", "staging", "retail"),
        ("models/retail/orders/marts/x.sql", "marts", "retail"),
        ("models/other/x.sql", "unknown", None),
        ("models/a/marts/staging/x.sql", "staging", "a"),
        ("models/staging.sql", "unknown", None),
        ("x.sql", "unknown", None),
        ("staging/x.sql", "staging", None),
    ],
)
def test_paths(spark, path, layer, group):
    assert one(spark, paths.layer_of, path) == layer
    assert one(spark, paths.group_of, path) == group


def test_stem(spark):
    assert one(spark, paths.stem_of, "models/a/b.c.sql") == "b.c"
    assert one(spark, paths.stem_of, "models/a/.sql") == ".sql"


def test_refs_and_sources_keep_order_and_repeats(spark):
    sql = """select * from {{ ref('a') }} join {{ ref( "b" ) }} -- ref('c')
             join {{ ref('a') }} join {{ source( 's' , "t" ) }} join {{ ref('two', 'args') }}"""
    assert one(spark, templates.refs_of, sql) == ["a", "b", "c", "a"]
    assert [tuple(x) for x in one(spark, templates.sources_of, sql)] == [("s", "t")]


def test_strip_and_restore(spark):
    sql = "select {{ var('x') }} from {{ source('a', 'b') }} join {{ ref('a__b_long') }}{% if x %}{{\n multi\n}}{% endif %}"
    plain = one(spark, templates.strip_templates, sql)
    assert plain == "select unknown_macro from a__b join a__b_long{% if x %}unknown_macro{% endif %}"
    mapping = one(spark, templates.placeholders, sql)
    assert mapping == {"a__b": "{{ source('a', 'b') }}", "a__b_long": "{{ ref('a__b_long') }}"}
    # Longest first: the shorter placeholder is then found inside the restored call as well.
    back = one(spark, lambda t, s: templates.restore(t, templates.placeholders(s)), "from a__b_long", sql)
    expected = "from a__b_long"
    for key in sorted(mapping, key=lambda k: -len(k)):
        expected = expected.replace(key, mapping[key])
    assert back == expected


def test_placeholder_keeps_last_call(spark):
    sql = "{{ ref('m') }} {{ ref(\"m\") }}"
    assert one(spark, templates.placeholders, sql) == {"m": '{{ ref("m") }}'}


def test_relation_names(spark):
    assert one(spark, templates.relation_name, "{{ source('a', 'b') }}") == "a.b"
    assert one(spark, templates.relation_name, "{{ ref('m') }}") == "m"
    assert one(spark, templates.relation_name, "plain") == "plain"


@pytest.mark.parametrize(
    "text, name, kind",
    [
        ("1", "x", "constant"),
        ("1.5e3", "x", "constant"),
        ("'a + b'", "x", "constant"),
        ("null", "x", "unknown"),
        ("sum(a) over (partition by b)", "x", "window"),
        ("row_number() over w", "x", "window"),
        ("sum(case when a then 1 end)", "x", "conditional"),
        ("cast(sum(a) as numeric(18, 2))", "x", "cast"),
        ("cast(a as int) + cast(b as int)", "x", "calculated"),
        ("a::numeric(18, 2)", "x", "cast"),
        ("a::numeric / b", "x", "calculated"),
        ("coalesce(a, 0)::int", "x", "cast"),
        ("count(*)", "x", "aggregate"),
        ("coalesce(sum(a), 0)", "x", "aggregate"),
        ("a", "a", "direct"),
        ("t.a", "a", "direct"),
        ("t.a", "b", "rename"),
        ("a - b", "x", "calculated"),
        ("-a", "x", "unknown"),
        ("lower(trim(a))", "x", "calculated"),
        ("current_date", "x", "calculated"),
        ("a || '-' || b", "x", "unknown"),
        ("(a + b)", "x", "calculated"),
        ("(a)", "x", "unknown"),
        ("'over (' || a", "x", "unknown"),
        ("discount", "count", "rename"),
        ("data -> 'k'", "x", "unknown"),
    ],
)
def test_transformation_types(spark, text, name, kind):
    assert one(spark, X.transformation_type, text, name) == kind


@pytest.mark.parametrize(
    "text, names",
    [
        ("a + t.b - a", ["a", "t.b"]),
        ("coalesce(x.y, 'z w')", ["x.y"]),
        ("cast(a as numeric(18, 2))", ["a"]),
        ("cast(a as timestamp with time zone)", ["a"]),
        ("a::double precision + b", ["a", "b"]),
        ("case when s in ('a') and n is not null then v else 0 end", ["s", "n", "v"]),
        ("sum(a) over (partition by b order by c desc rows between 29 preceding and current row)", ["a", "b", "c"]),
        ("extract(year from d)", ["d"]),
        ("current_date - interval '30 day'", []),
        ("date '2020-01-01' - d", ["d"]),
        ("ts at time zone 'UTC'", ["ts"]),
        ("x.ts AT TIME ZONE tz", ["x.ts", "tz"]),
        ("at + time + zone", ["at", "time", "zone"]),
        ("substring(a from 2 for 3)", ["a"]),
        ("overlay(a placing b from 2 for n)", ["a", "b", "n"]),
        ('"a.b" + c + t."d e" + "T"."x.y"', ['"a.b"', "c", "t.d e", 'T."x.y"']),
        ("1", []),
    ],
)
def test_referenced_columns(spark, text, names):
    assert one(spark, lambda t: X.referenced_columns(X.code_of(t)), text) == names


def test_statement_profile(spark):
    sql = """with recursive a as (select 1), b as materialized (select count(*), Sum(x) from t)
      -- from z cross join where
      select string_agg(x, 'left join') from a
      natural left join b full outer join c on true cross join d join e on 'where' = /* over( */ ''"""
    code = lambda f: (lambda t: f(X.code_of(t)))
    assert one(spark, code(X.join_types), sql) == ["LEFT NATURAL", "FULL OUTER", "CROSS", "INNER"]
    assert one(spark, code(X.cte_names), sql) == ["a", "b"]
    assert one(spark, code(X.aggregate_functions), sql) == ["COUNT", "SUM", "GROUPCONCAT"]
    assert one(spark, code(X.has_where), sql) is False
    assert one(spark, code(X.has_window), sql) is False


def test_skeleton_follows_deep_nesting(spark):
    text = "f(" * 40 + "a" + ")" * 40 + " + g((b))"
    assert one(spark, X.skeleton, text) == "f() + g()"


def test_comments_leave_a_blank_and_keywords_go_by_place(spark):
    from tributary.functions import expressions as X

    cases = {
        "from/*h*/orders": "from orders",
        "'a--b' || x -- 'c'": "'a--b' || x  ",
    }
    for sql, want in cases.items():
        row = spark.createDataFrame([(sql,)], "s string").select(X.without_comments(F.col("s")).alias("o")).first()
        assert row.o.rstrip() == want.rstrip()
    refs = {
        "first + s.last + range": ["first", "s.last", "range"],
        'sum(s."Amt") over (order by s.day nulls last rows between unbounded preceding and current row)': ["s.Amt", "s.day"],
        "sum(x) filter (where rows > 1)": ["x", "rows"],
        "d + interval '1 day'": ["d"],
    }
    for text, want in refs.items():
        got = spark.createDataFrame([(text,)], "s string").select(X.referenced_columns(X.code_of(F.col("s"))).alias("o")).first().o
        assert got == want, text
    kinds = {('s."Amt"', "Amt"): "direct", ('s."Amt"', "other"): "rename"}
    for (text, name), want in kinds.items():
        row = spark.createDataFrame([(text, name)], "s string, n string").select(X.transformation_type(F.col("s"), F.col("n")).alias("o")).first()
        assert row.o == want


def test_guarded_patterns_keep_their_results(spark):
    texts = ["a", "f(a)", "f((a))", "f(((a)))", "f((((a))))", "f(((((a)))))", "cast(a as int)\n", "cast((a) as int)", ")a(", "f(a", "f(a))", "(a)(b)", "f()", "f(())",
             "a AS\tint", "last", "x::numeric(3, 2)", "'it''s' || a -- b", "a /* b */ + c", "a \u0001 b", "EXTRACT(day FROM t)", "date '2020'", 't."a.b"', "Sum(a) OVER (order by b NULLS last)", "cAse when a then b end"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    code = X.code_of(F.col("t"))
    shapes = df.select("t", X.skeleton(F.col("t")).alias("s")).collect()

    def walked(text):
        if "(" not in text:
            return text.strip(" ")
        depth, out = 0, ""
        for piece in text:
            after = depth + {"(": 1, ")": -1}.get(piece, 0)
            out += piece if min(depth, after) <= 0 else ""
            depth = after
        return out.strip(" ")

    assert [r.s for r in shapes] == [walked(r.t) for r in shapes]
    made = {r.t: r for r in df.select("t", X.transformation_type(F.col("t"), F.lit("a")).alias("k"), X.referenced_columns(code).alias("r"), code.alias("c")).collect()}
    assert made["cast(a as int)\n"].k == "cast" and made["cast((a) as int)"].k == "cast" and made["x::numeric(3, 2)"].k == "cast"
    assert made["cAse when a then b end"].k == "conditional" and made["Sum(a) OVER (order by b NULLS last)"].k == "window"
    assert made["EXTRACT(day FROM t)"].r == ["t"] and made["a AS\tint"].r == ["a"] and made["date '2020'"].r == []
    assert made["Sum(a) OVER (order by b NULLS last)"].r == ["a", "b"] and made['t."a.b"'].r == ['t."a.b"']
    assert made["a \u0001 b"].c == "a   b" and made["a /* b */ + c"].r == ["a", "c"]
