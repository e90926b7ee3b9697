"""Operators on small fixtures in the corpus's own shapes."""

import json
import math

import pytest
from pyspark.sql import functions as F

from scriptsieve.functions import pages, text, urls
from scriptsieve.operators import learning, metrics, pairing, rules, sampling, tokens, trace
from scriptsieve.sources import readers, writers
from scriptsieve.streaming import traces as streams

CALLS = "script string, seq long, symbol string, argument string, value string"


def calls(spark, rows):
    return spark.createDataFrame([(s, i, sym, a, v) for i, (s, sym, a, v) in enumerate(rows)], CALLS)


def test_rules(spark):
    draw = "c.fillText(x); c.fillStyle = y; c.toDataURL()"
    many = "font = 'a'; measureText(b);"
    rows = [draw, draw + " c.restore()", many * 20, many * 21, "createOffer onicecandidate createOscillator oncomplete", "font = " * 21 + "measureText" * 21, ""]
    df = spark.createDataFrame([(r,) for r in rows], "script string")
    got = {r.script: r.categories for r in rules.categorised(df).collect()}
    assert got == {draw: ["Canvas Fingerprinting"], rows[3]: ["Canvas Font Fingerprinting"], rows[4]: ["WebRTC Fingerprinting", "AudioContext Fingerprinting"], rows[5]: ["Canvas Font Fingerprinting"]}
    assert rules.categorised(df, keep_empty=True).count() == len(rows)


def test_text_functions(spark):
    df = spark.createDataFrame([("\xa0 a b\x1c\n",), ("c",), (None,)], "s string")
    assert [r[0] for r in df.select(text.strip(F.col("s"))).collect()] == ["a b", "c", None]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.clean_script(F.lit(" a\r\n\tb "))) == "a   b"
    assert one(text.after_first(F.lit("js_a_b"), "_")) == "a_b" and one(text.after_first(F.lit("js"), "_")) == "js"
    assert [one(text.number(F.lit(x))) for x in ("1", " 1.5 ", "1d", "1_0", "x", "-2e3", "")] == [1.0, 1.5, None, None, None, -2000.0, None]
    assert [one(text.is_whole(F.lit(x))) for x in ("-12", "1.0", "")] == [True, False, False]
    assert one(text.fenced(F.lit("so:\n```ts\nlet x\n```\nend"))) == "let x" and one(text.fenced(F.lit(" y "))) == "y"
    assert one(text.halves(F.lit("abcde"))) == ["ab", "cde"]
    page = "<script>old</script><script>b</script>"
    assert one(text.replace_first(F.lit(page), pairing.SCRIPT_TAG, F.lit("$1\\n"))) == "<script>$1\\n</script><script>b</script>"


def test_urls(spark):
    from urllib.parse import urljoin

    base = "http://h:80/a/b.html?q=1#f"
    for href in ("http://o/x", "//o/y", "/r", "c/d.html", "#z", "?w=2", ""):
        df = spark.createDataFrame([(base, href)], "b string, h string")
        r = df.select(urls.absolute(F.col("b"), F.col("h")), urls.resolve("b", "h")).first()
        assert r[1] == urljoin(base, href)
        if href:
            assert r[0] == r[1]
    names = spark.createDataFrame([("http://h/",), ("http://h",), ("http://h/a/b.c/",)], "u string")
    assert [r[0] for r in names.select(urls.output_key(F.col("u"))).collect()] == ["index", "index", "a_b_c"]


def test_pages(spark):
    code = "document.getElementById('myCanvas'); document.querySelector('.x y'); document.getElementsByClassName(\"b a\"); document.getElementsByTagName('p'); document.getElementsByTagName('a'); document.getElementById('Svg1')"
    html = spark.range(1).select(pages.placeholders(F.lit(code)), pages.sandbox(F.lit(code))).first()
    assert html[0].split("\n    ") == ['<svg id="Svg1"></svg>', '<canvas id="myCanvas"></canvas>', '<div class="a"></div>', '<div class="b"></div>', "<p></p>"]
    assert code in html[1] and html[0] in html[1]


def test_trace_order_and_counts(spark):
    c = calls(spark, [("s", " Font ", None, "1"), ("s", " Font ", None, "1"), ("s", "b", None, "1"), ("s", " Font ", None, "1"), ("s", "b", None, None), ("s", "b", None, None), ("s", None, None, None)])
    assert [r.seq for r in trace.without_repeats(c).orderBy("seq").collect()] == [0, 2, 3, 4, 6]
    assert trace.onegram_maps(c).first().onegrams == {"font": 3, "b": 3}


def test_ground_truth(spark):
    x = "CanvasRenderingContext2D."
    fonts = [("f", f"{x}font", None, str(i)) for i in range(20)] + [("f", f"{x}measureText", None, None)] * 21
    drawn = [("d", f" {x}FillText ", None, None), ("d", f"{x}strokeStyle", None, "#f"), ("d", "HTMLCanvasElement.toDataURL", None, None)]
    rows = [*fonts, ("f", f"{x}fontKerning", None, None), *drawn, *[("e", s, a, v) for _, s, a, v in drawn], ("e", f"{x}save", None, None), ("g", "x", None, None), ("g", None, None, None), ("a", "OfflineAudioContext.oncomplete", None, None)]
    got = {r.script: tuple(r)[1:] for r in trace.ground_truth(calls(spark, rows)).collect()}
    assert got == {"f": (False, False, True, False, True), "d": (True, False, False, False, True), "e": (False,) * 5, "g": (False,) * 5, "a": (False, False, False, True, True)}
    assert {r.script: r.is_canvasfont for r in trace.ground_truth(calls(spark, fonts)).collect()} == {"f": False}


def test_features(spark):
    x = "CanvasRenderingContext2D."
    c = calls(spark, [
        ("s", "window.document.cookie", None, "a;b;c"), ("s", f"{x}fillStyle", None, "linear(1)"), ("s", f"{x}fillStyle", None, "#fff"), ("s", f"{x}fillStyle", None, "null"), ("s", f"{x}fillStyle", None, " "),
        *[("s", f"{x}filter", None, f"blur({i})") for i in range(6)], ("s", "other", None, "v"),
        ("s", f"{x}rect", "[-1, 0, 2, \"3\"]", None), ("s", f"{x}rect", "[1, 0, 2]", None), ("s", f"{x}arc", "[1, 1]", None), ("s", f"{x}arc", "[1, 1, 2]", None), ("s", f"{x}rect", "nope", None),
        ("s", f"{x}rect", "{\"0\": 1, \"1\": \"1_0\"}", None), ("s", f"{x}rect", "7", None), ("s", "document.getElementsByTagName", "[\"div\"]", None), ("s", "document.getElementsByTagName", "[\"zz\"]", None),
    ])
    values = trace.value_features(c, keep_empty=True)
    got = {r.name: r["values"] for r in values.collect()}
    assert got == {"window.document.cookie": ["3"], f"{x.lower()}fillstyle": ["gradient", "color"], f"{x.lower()}filter": [f"blur({i})" for i in range(5)], "other": []}
    assert "other" not in {r.name for r in trace.value_features(c).collect()}
    args = trace.argument_features(c)
    got = {r.name: r["values"] for r in args.collect()}
    assert got[f"{x.lower()}rect-OnScreen"] == ["0", "1", "0"] and got[f"{x.lower()}rect-Size"] == ["6.0", "0.0", "0.0"]
    assert got[f"{x.lower()}arc-OnScreen"] == ["1", "1"] and [float(v) for v in got[f"{x.lower()}arc-Size"]] == [0.0, pytest.approx(4 * math.pi)]
    hot = {r.name: r.vectors for r in trace.one_hot(trace.combined_features(values, args)).collect()}
    assert hot[f"{x.lower()}fillstyle"] == [[1, 0], [0, 1]] and hot["document.getelementsbytagname"][1] == [0] * 9 and hot["document.getelementsbytagname"][0][2] == 1
    wide = writers.wide(args).first()
    assert json.loads(wide[f"{x.lower()}rect-Size"]) == ["6.0", "0.0", "0.0"]
    assert trace.setter_calls(c).count() == 2


def test_sampling(spark):
    df = spark.createDataFrame([(i, ["x", "a"] if i % 2 else ["b"], i % 3 == 0) for i in range(100)], "key int, categories array<string>, label boolean")
    first = sampling.first_category(F.col("categories"), ["a", "b"])
    got = sampling.stratified(df, first, ["a", "b"], 10, "key").groupBy("category").count().collect()
    assert {r.category: r["count"] for r in got} == {"a": 5, "b": 5}
    with pytest.raises(sampling.TooFew):
        sampling.stratified(df, first, ["a", "b"], 200, "key")
    with pytest.raises(ValueError):
        sampling.two_sources(df, df, first, ["a", "b"], 5, 5)
    assert sampling.reservoir(df, 500, "key").count() == 100 and sampling.two_sources(df, df, first, ["a", "b"], 5, 10).count() == 15
    counts = [r["count"] for r in sampling.folds(df, "label", "key").groupBy("label", "fold").count().collect()]
    assert sum(counts) == 100 and max(counts) - min(counts) <= 4
    b = sampling.balanced(df.withColumn("y", F.col("label").cast("int")), "y", "key").groupBy("y").count().collect()
    assert {r.y: r["count"] for r in b} == {0: 34, 1: 34}


def test_pairing(spark, tmp_path):
    for name, body in {"js_a_2.json": {"1": {"label": 1, "content": "é"}}, "js_a_10.json": {"2": {"label": 0, "content": "b"}}, "wasm_a_1.json": {"1": {"label": 1, "content": "ccc"}}, "js_b_1.json": {"1": {"label": 1, "content": ""}}, "wasm_b_1.json": {"1": {"label": 1, "content": "z"}}, "js_only_1.json": {"1": {"label": 1, "content": "q"}}, "odd.json": {}}.items():
        (tmp_path / name).write_text(json.dumps(body))
    parts = readers.converted_parts(spark, str(tmp_path))
    assert {(r.kind, r.base, r.parts, r.content) for r in pairing.combined(parts).collect()} >= {("js", "a", 2, "é\nb")}
    s = pairing.compared(*(pairing.sizes(parts.where(F.col("kind") == k), "base") for k in ("js", "wasm")))
    got = {r.base: (r.status, r.diff, r.pct) for r in s.collect()}
    assert got == {"a": ("both", 0, 0.0), "b": ("both", 1, math.inf), "only": ("only_js", None, None)}
    t = pairing.totals(s).first()
    assert (t.pairs, t.js_bytes, t.wasm_bytes) == (2, 3, 4) and pairing.report(s).count() == 2
    p = spark.createDataFrame([("1", "<script>a</script><script>b</script>"), ("2", "none"), ("3", "<script>c</script>")], "key string, html string")
    new = spark.createDataFrame([("1", "$1\\"), ("2", "x")], "key string, content string")
    assert {r.key: (r.status, r.html) for r in pairing.updated_pages(p, new).collect()} == {"1": ("updated", "<script>$1\\</script><script>b</script>"), "2": ("no_script", "none"), "3": ("missing", "<script>c</script>")}


def test_readers_and_writers(spark, tmp_path):
    d = tmp_path / "dumps"
    d.mkdir()
    (d / "scraped_js1.json").write_text(json.dumps([{"content": {"k": [{"script_content": " a \xa0"}, {"script_content": None}, {}, {"script_content": " "}], "e": []}}, {}]))
    (d / "scraped_js2.json").write_text('[{"content": {"k": [')
    dumps = readers.script_dumps(spark, str(d))
    assert [r.script for r in readers.flattened(dumps).collect()] == ["a"]
    assert sorted(r.script for r in readers.flattened(dumps, stripped=False).collect()) == [" ", " a \xa0"]
    assert [r.file.rsplit("/", 1)[1] for r in readers.malformed_dumps(spark, str(d)).collect()] == ["scraped_js2.json"]
    t = tmp_path / "traces" / "f1"
    t.mkdir(parents=True)
    (t / "12_html.json").write_text(json.dumps({"h": {"information": [{"symbol": "S", "argument": "[1]", "value": 5, "timestamp": 1.5}, {"symbol": "T"}], "content_hash": "c"}}))
    got = readers.traces(spark, str(tmp_path / "traces")).orderBy("seq").collect()
    assert [(r.folder, r.script_no, r.script_hash, r.seq, r.symbol, r.value) for r in got] == [("f1", "12", "h", 0, "S", "5"), ("f1", "12", "h", 1, "T", None)]
    k = tmp_path / "keyed"
    k.mkdir()
    (k / "a.json").write_text(json.dumps([{"x": {"label": "1", "content": "old"}}, {"x": {"label": "0", "content": "new"}, "y": {"label": "1"}}]))
    assert {r.key: (r.label, r.content) for r in readers.keyed_items(spark, str(k)).collect()} == {"x": ("0", "new"), "y": ("1", None)}
    (tmp_path / "v.json").write_text('{"tok": 3}')
    assert readers.vocabulary(spark, str(tmp_path / "v.json")).first() == ("tok", 3)
    (tmp_path / "p.html").write_text("<b>\n</b>")
    assert readers.html_pages(spark, str(tmp_path)).first() == ("p", "<b>\n</b>")
    c = spark.createDataFrame([('a "q", \t\r\nb', ["x", "y"])], readers.CATEGORISED)
    writers.quoted_csv(c, str(tmp_path / "csv"))
    back = readers.categorised_csv(spark, str(tmp_path / "csv")).first()
    assert back.categories == ["x", "y"] and back.script.split() == ['a', '"q",', "b"]
    writers.json_lines(c, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    items = spark.createDataFrame([("js", "b", f"{i}", "k") for i in range(120)], "kind string, base string, content string, key string")
    writers.batches(items.coalesce(1), str(tmp_path / "batches"))
    assert len(list((tmp_path / "batches" / "kind=js").glob("part*"))) == 3
    writers.by_kind_and_base(items, str(tmp_path / "kinds"))
    writers.append_log(items, str(tmp_path / "log"))
    writers.append_log(items, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 240
    writers.one_file_a_row(items.limit(1), str(tmp_path / "rows"))
    assert json.loads(writers.nested(items.limit(1)).first().value)["kind"] == "js"
    spark.createDataFrame([(1.0, [1, 2])], "label double, seq array<int>").write.parquet(str(tmp_path / "seq"))
    assert readers.sequences(spark, str(tmp_path / "seq")).first().seq == [1, 2]


def test_tokens(spark):
    code = "var a = /*c*/ 'x;y' + b1; // z\nif (a >= 0x1F) { f(`t`) }"
    assert spark.range(1).select(tokens.script_tokens(F.lit(code))).first()[0] == ["var", "a", "=", "'x;y'", "+", "b1", ";", "if", "(", "a", ">=", "0x1F", ")", "{", "f", "(", "`t`", ")", "}"]
    df = spark.createDataFrame([(1, ["aa"] * 5 + ["b", "c"]), (2, ["aa"])], "k int, t array<string>")
    counts = tokens.counted(df, "k", F.col("t"))
    assert {(r.token, r.n) for r in tokens.frequent(counts, 6, ["b"]).collect()} == {("aa", 6), ("b", 1)}
    assert {(r.k, r.token) for r in tokens.dominant(counts, "k", 0.5).collect()} == {(1, "aa"), (2, "aa")}
    assert spark.range(1).select(tokens.filtered_by_api(F.array(F.lit("A:document"), F.lit("B:x")), ["doc"])).first()[0] == ["A:document"]


def test_learning(spark):
    rows = spark.createDataFrame([(i, float(i % 2), [11, 12, 5] if i % 2 else [21, 22, 7]) for i in range(60)], "key int, label double, seq array<int>")
    data = learning.as_tokens(rows)
    assert data.first().tokens == ["21", "22"]
    model = learning.fitted(data, trees=5, depth=3)
    scores = learning.transferred({"m": model}, {"all": data}).collect()
    assert [(r.model, r.dataset, r.accuracy, r.f1) for r in scores] == [("m", "all", 1.0, 1.0)]
    folds = learning.cross_validated(data, "key", 3, trees=3, depth=2)
    assert [r.accuracy for r in folds.collect()] == [1.0] * 3 and metrics.over_folds(folds, "f1").first().std == 0.0
    assert {r.token for r in learning.importances(model, spark, 4).collect()} == {"11", "12", "21", "22"}
    scored = model.transform(data)
    moved = learning.contributions(scored, model, "key", 2).collect()
    assert {r.key for r in moved} == {str(i) for i in range(60) if i % 2} and all(r.contribution > 0 for r in moved)
    assert learning.probabilities(scored).first().probabilities[0] == pytest.approx(1.0)
    assert learning.hashed(data).first().features.size == 256
    assert len(learning.standardised(learning.pooled(data, "key", 4)).first().scaled) == 4


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", 0, "A", None, "1"), ("s", 1, "A", None, "1"), ("t", 0, "A", None, None), ("s", 2, "B", None, None), ("s", 3, "B", None, None), ("t", 1, "A", None, None), ("s", 4, "A", None, "1")]
    df = spark.createDataFrame(rows, CALLS)
    for k, part in enumerate((df.where("seq < 2"), df.where("seq >= 2"))):
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    got = []
    q = streams.without_repeats(streams.read(spark, str(tmp_path / "in")).repartition(2)).writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.script, r.seq) for r in got) == sorted((r.script, r.seq) for r in trace.without_repeats(df).collect())
    n = streams.onegrams(streams.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("onegrams").outputMode("complete").trigger(availableNow=True).start()
    assert n.awaitTermination(120)
    assert {tuple(r) for r in spark.table("onegrams").collect()} == {tuple(r) for r in trace.onegrams(df).collect()}
