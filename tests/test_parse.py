import pytest

from sluicewire.lang import QueryParseError, ast, parse, parse_filter


def test_every_stage_kind():
    kinds = [type(parse(q).stages[0]) for q in ("a == 1", "show a, b", "* where a", "aggregate count()", "correlate a with b", "top(3) by a", "order by a desc", "limit 4")]
    assert kinds == [ast.Filter, ast.Show, ast.Show, ast.Aggregate, ast.Correlate, ast.Top, ast.OrderBy, ast.Limit]


def test_correlate_defaults_to_100_ms():
    assert parse("correlate a with b").stages[0].within_ms == 100
    # a band that is asked to be zero is zero
    assert parse("correlate a with b within 0ms").stages[0].within_ms == 0
    assert parse("correlate a with b within 2m").stages[0].within_ms == 120_000


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("correlate a == 1", "expected 'with' in correlate clause"),
        ("", "empty query"),
        ("  ", "empty query"),
        ("a == 1 b", "unexpected trailing input"),
        ("aggregate median(x)", "unknown aggregation function 'median'"),
        ("aggregate count() window 5", "expected duration unit (ms, s, m, h)"),
        ("aggregate count() window x", "expected duration value"),
        ("aggregate count() window sliding(1m)", "expected ',' in sliding window"),
        ("aggregate percentile(x)", "expected ',' in percentile()"),
        ("aggregate percentile(x, 101)", "expected percentile value"),
        ("aggregate count() window 0s", "duration must be positive"),
        ("aggregate count() by a by b", "repeated 'by' clause"),
        ("show", "expected field list for show"),
        ("a == 1 |", "expected filter expression"),
        ("(a == 1", "expected ')' in filter expression"),
    ],
)
def test_errors(text, message):
    with pytest.raises(QueryParseError) as e:
        parse(text)
    assert e.value.message == message


def test_precedence_and_word_boundaries():
    assert parse_filter("a or b and c") == ast.Or(ast.Exists("a"), ast.And(ast.Exists("b"), ast.Exists("c")))
    assert parse_filter("NOT (a and b)") == ast.Not(ast.And(ast.Exists("a"), ast.Exists("b")))
    assert parse_filter("notes == 'x' and order > 1") == ast.And(ast.Compare("notes", "==", "x"), ast.Compare("order", ">", 1))


def test_literals():
    got = [parse_filter(f"a == {x}").value for x in ('"q \\" x"', "'s'", "5", "5000000000", "-1.5e3", "true", "WARN", "10.0.0.1", "/x")]
    assert got == ['q " x', "s", 5, 5_000_000_000, -1500.0, True, ast.Word("WARN"), ast.Word("10.0.0.1"), ast.Word("/x")]
    assert parse_filter("a == null") == ast.Not(ast.Exists("a"))
    assert parse_filter("a IN (1, 'b', c)").values == (1, "b", ast.Word("c"))


def test_regex_forms():
    assert [parse_filter(f"a =~ {x}").pattern for x in ("/a\\/b/i", '"a.b"', "^x.*")] == ["(?i)a/b", "a.b", "^x.*"]


def test_clauses_in_any_order_and_field_names():
    one = parse("aggregate count() by a.b-c, `x y` where d > 1 window 1m")
    assert one == parse("aggregate (count()) window tumbling(1m) where d > 1 by a.b-c, `x y`")
    assert one.stages[0].by == ("a.b-c", "x y")


def test_metric_columns():
    names = [f.column for f in parse("aggregate count(), sum(x), avg(x), percentile(x, 95), percentile(x, 99.9), distinct(x)").stages[0].funcs]
    assert names == ["count", "x", "avg_x", "p95_x", "p99_9_x", "distinct_x"]
