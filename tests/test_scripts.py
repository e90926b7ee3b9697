import pytest

from scriptsieve.operators import script_rules as R
from scriptsieve.operators import spans
from scriptsieve.operators.script_syntax import SyntaxFault, parse

GOOD = [
    "var a=1,b='x';", "let {a,b:[c]}=d; for(let i=0;i<3;i++){f(i)}", "for(var k in o) g(k); for (const x of y) {}", "if(a){b()}else if(c)d();else{e}", "x=>x+1; (a,b=2)=>({c:a}); async (q)=>{await q}",
    "`a${b+`c${d}`}e`", "/a[/]b/g.test(s)", "class A extends B{static x=1; get y(){return 1} async z(){} constructor(){super()}}", "new Foo(1).bar; new (a.b)(); new X", "a?.b?.[c]?.(d)",
    "do{x++}while(x<3)\nlabel: for(;;){break label}", "switch(a){case 1: b(); default: c}", "try{a}catch(e){b}finally{c}", "(function(){ return function*(){ yield 1 } })()",
    "x = {a, b(){}, get c(){return 1}, [d]: 1, ...e, 'f': 2, async g(){}}", "var a = b\n(c)\nvar d", "a = b / c / d; e = f\n/g/h", "var of = 1; for (var x of of) {}", "<!-- old\nvar x", "",
]


@pytest.mark.parametrize("text", GOOD)
def test_parses(text):
    parse(text)


@pytest.mark.parametrize("text", ["var = 1", "if(", "a b", "{", "'x", "f(,)", "try{}", "`${a`", "(" * 5000])
def test_faults(text):
    with pytest.raises(SyntaxFault):
        parse(text)


def found(text, rule):
    return [(text[s:e], a) for r, s, e, a in R.matches(text, parse(text)) if r == rule]


def test_rules():
    assert found("var a = 'x'; for (var i = 0; i < 2; i++) {} let f = -1.5, g = 2;", R.LITERALS) == [("var a = 'x';", {"name": "a", "kind": "string", "value": "'x'"}), ("let f = -1.5, g = 2;", {"name": "g", "kind": "int", "value": "2"})]
    assert [t for t, _ in found("x = eval(a); new Function('b'); w.atob('c', 1 + 2)", R.RUN)] == ["eval(a)", "w.atob('c', 1 + 2)"]
    assert found("w.atob('c', d, 1 + 2)", R.RUN)[0][1]["arguments"] == "'c',d,complex_expression"
    assert len(found("var a = [1, true], b = [1.5, 2.5], c = [1, 2.5], d = [];", R.INTS)) == 1 and len(found("var b = [1.5, 2.5];", R.FLOATS)) == 1
    assert [t for t, _ in found("while (a.b < c) d()", R.WHILES)] == ["while (a.b < c) d()"] and found("while (a.b < c) d()", R.WHILES)[0][1]["names"] == "a,c"
    assert [t for t, _ in found("a(); b(); x = c()", R.CALLS)] == ["b();"]
    assert [t for t, _ in found("width.width; a['b']; a[b]", R.MEMBERS)] == ["width", "b"]
    assert [t for t, _ in found("canvas(); screen.width; canvas.x", R.CALLEES)] == ["canvas()", "screen.width"]
    assert [t for t, _ in found("x = {'canvas' : 1}; y = \"canvas\"", R.WORDS)] == ['"canvas"']
    assert [t for t, _ in found("screen.width + canvas.x", R.OBJECTS)] == ["screen", "canvas"]
    assert len(found("class A {} x = class {}; function f() {} g = () => 1", R.CLASSES)) == 2 == len(found("function f() {} g = () => 1", R.FUNCTIONS))
    assert len(found("for (var i = 0;;) {} for (;;) {} for (var a, b;;) {}", R.FORS)) == 1


def test_refused_ifs_stop_the_descent():
    text = "if (a) { return_value() } if (f) { throw g; if (h) i() } if (c) { if (d) { e() } }"
    assert [t for t, _ in found(text, R.IFS)] == ["if (c) { if (d) { e() } }", "if (d) { e() }"]


def test_features():
    tree = parse("document.cookie = a; if (b) c; else if ('d') { }")
    assert "MemberExpression:document" in R.features(tree) and "MemberExpression:cookie" in R.features(tree)
    assert R.statement_features(tree) == ["If: Identifier: b", "If: Literal: 'd'"]


def test_spans_are_chosen_and_spliced(spark):
    rows = [("abcdefghij", [(2, 5, 1, 0), (4, 6, 2, 0), (5, 5, 3, 0), (5, 8, 1, 1), (2, 3, 4, 0), (2, 5, 1, 0)]), ("", [])]
    df = spark.createDataFrame(rows, f"script string, spans array<{spans.SPAN}>").withColumn("taken", spans.chosen(spans.F.col("spans")))
    codes = spans.F.create_map(*[x for k, v in ((1, "<1>"), (3, "|")) for x in (spans.F.lit(k), spans.F.lit(v))])
    got = df.select("taken", spans.coverage(spans.F.col("taken"), spans.F.col("script")), spans.spliced(spans.F.col("taken"), spans.F.col("script"), codes)).collect()
    assert [(s.start, s.end, s.rule) for s in got[0][0]] == [(2, 5, 1), (5, 8, 1)]
    assert got[0][1] == 0.6 and got[0][2] == "ab<1><1>ij" and got[1][1] == 0.0 and got[1][2] == ""


def test_quoted_canvas_equals_the_parser(spark):
    texts = ["a = 'canvas'; b = {\"canvas\" : 1}; c = \\'canvas\\'", "'canvas'", "none", "'canvas'  :"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", spans.quoted_canvas(spans.F.col("s")).alias("q")).collect():
        want = [(s, e) for rule, s, e, _ in R.matches(r.s, {"type": "Program", "start": 0, "end": 0, "body": []}) if rule == R.WORDS]
        assert [(q.start, q.end) for q in r.q] == want


def test_frames(spark):
    df = spark.createDataFrame([("a", "var x = 1;"), ("b", "var ="), ("c", None)], "key string, script string")
    assert [(r.key, r.rule, r.start, r.end, r.attrs["name"]) for r in R.match_rules(df).collect()] == [("a", 1, 0, 10, "x")]
    assert {r.key: r.parsed for r in R.parse_checks(df).collect()} == {"a": True, "b": False, "c": True}
