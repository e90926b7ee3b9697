"""The registered queries of the engine over the supplied tables, each with the SQL that gives the same rows.

The tables stand in for the corpus: `events` for traces (a user's events are a script's calls), `pages` for stored pages and
their scripts, `documents` for script texts, `labels` for labels, `conversations` for part files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as number_functions
from ..functions import pages as page_functions
from ..functions import text as T
from ..functions import urls
from ..operators import metrics, pairing, rules, sampling, spans, tokens, trace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """events as a trace; seq orders a user's events by time and id."""
    e = table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("script"), seq.cast("long").alias("seq"), F.col("event_type").alias("symbol"), F.col("props").alias("argument"), F.floor("value").cast("long").cast("string").alias("value"))


CALLS = "calls as (select user_id as script, row_number() over (partition by user_id order by ts, event_id) as seq, event_type as symbol, props as argument, floor(value)::bigint::varchar as value from events)"

SIGNALS = trace.Signals(contains={"text": ["click"], "style": ["view"], "font": ["signup"], "measure": ["purch"]}, equals={"state": ["error"]}, order=["text", "style", "state", "font", "measure"])
TEXT_RULES = (
    rules.Rule("articles", any_of=[["the ", "der "], ["and ", "und "]], none_of=["token", "@"]),
    rules.Rule("romance", any_of=[["que ", "les "], ["de ", "la "]]),
    rules.Rule("frequent", more_than={"[aeiou]n ": 20, "er": 20}),
    rules.Rule("marked", all_of=[r"[!#$%]"]),
)


@query("agg1_onegram_counts", "select user_id as script, lower(event_type) as symbol, count(*)::bigint as n from events group by all")
def onegram_counts(spark, d):
    return trace.onegrams(calls(spark, d))


@query("agg1_onegram_map", "select script, string_agg(symbol || '=' || n, ',' order by symbol) as onegrams from (select user_id as script, event_type as symbol, count(*) as n from events group by all) group by script")
def onegram_map(spark, d):
    pairs = F.transform(F.map_entries("onegrams"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return trace.onegram_maps(calls(spark, d)).select("script", F.array_join(pairs, ",").alias("onegrams"))


@query("seq1_consecutive_dedupe", f"with {CALLS} select script, seq, symbol from (select *, lag(symbol) over (partition by script order by seq) as b from calls) where b is distinct from symbol")
def consecutive_dedupe(spark, d):
    return trace.without_repeats(calls(spark, d), ("symbol",)).select("script", "seq", "symbol")


@query("agg2_first_values", f"with {CALLS} select script, symbol as name, string_agg(value, ',' order by seq) as first_values from (select *, row_number() over (partition by script, symbol order by seq) as k from calls) where k <= 5 group by all")
def first_values(spark, d):
    f = calls(spark, d).select("script", "seq", F.col("symbol").alias("name"), "value")
    return trace.first_values(f).select("script", "name", F.array_join("values", ",").alias("first_values"))


@query("agg5_distinct_with_null", f"with {CALLS}, v as (select script, case when value::bigint % 5 = 0 then null else value::bigint % 7 end as v from calls) select script, (count(distinct v) + max(case when v is null then 1 else 0 end))::bigint as n_values from v group by script")
def distinct_with_null(spark, d):
    v = F.when(F.col("value").cast("long") % 5 != 0, F.col("value").cast("long") % 7)
    return calls(spark, d).select("script", v.alias("v")).groupBy("script").agg((F.count_distinct("v") + F.max(F.col("v").isNull().cast("int"))).alias("n_values"))


def short_calls(spark, d):
    """The calls of a user dealt over ten scripts, which are short enough to lack some signals."""
    e = table(spark, d, "events").withColumn("script", F.col("user_id") * 10 + F.col("event_id") % 10)
    return e.select("script", F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), F.col("props").alias("argument"), F.floor("value").cast("long").cast("string").alias("value"))


@query(
    "trace_ground_truth",
    """with s as (select user_id * 10 + event_id % 10 as script, floor(value)::bigint::varchar as value, case when event_type like '%click%' then 'text' when event_type like '%view%' then 'style' when event_type = 'error' then 'state' when event_type like '%signup%' then 'font' when event_type like '%purch%' then 'measure' end as g from events),
    t as (select script, coalesce(bool_or(g = 'text'), false) and coalesce(bool_or(g = 'style'), false) and not coalesce(bool_or(g = 'state'), false) as x, coalesce(bool_or(g = 'state'), false) as st,
      count(distinct case when g = 'font' then value end) > 1 and count(*) filter (where g = 'measure') > 1 as f from s group by script)
    select script, x as is_drawn, st as has_state, f as is_font, x or f as is_any from t""",
)
def trace_ground_truth(spark, d):
    c = trace.normalised(short_calls(spark, d)).withColumn("signal", SIGNALS.column(F.col("symbol")))
    has = lambda n: F.coalesce(F.bool_or(F.col("signal") == n), F.lit(False))
    out = c.groupBy("script").agg(
        (has("text") & has("style") & ~has("state")).alias("is_drawn"), has("state").alias("has_state"),
        ((F.count_distinct(F.when(F.col("signal") == "font", F.col("value"))) > 1) & (F.count_if(F.col("signal") == "measure") > 1)).alias("is_font"),
    )
    return out.withColumn("is_any", F.expr("is_drawn or is_font"))


@query(
    "agg7_value_features",
    f"""with {CALLS}, v as (select script, seq, case symbol when 'click' then 'window.document.cookie' when 'view' then 'canvasrenderingcontext2d.fillstyle' when 'signup' then 'canvasrenderingcontext2d.filter' else symbol end as s,
      case when value::bigint % 3 = 0 then 'a;b(' || value || ')' when value::bigint % 3 = 1 then '#' || value when value::bigint % 2 = 0 then ' ' else 'null' end as x from calls),
    f as (select script, seq, s, case s when 'window.document.cookie' then len(string_split(x, ';'))::varchar when 'canvasrenderingcontext2d.fillstyle' then case when contains(x, '(') then 'gradient' else 'color' end when 'canvasrenderingcontext2d.filter' then case when contains(x, '(') then x else '' end end as y from v where trim(x) not in ('', 'null')),
    k as (select *, row_number() over (partition by script, s order by seq) as k from f where y is not null)
    select n.script, n.s as name, coalesce(string_agg(k.y, '|' order by k.k), '') as feature_values, count(k.y)::bigint as n_values from (select distinct script, s from f) n left join k on k.script = n.script and k.s = n.s and k.k <= 5 group by all""",
)
def value_features(spark, d):
    c = calls(spark, d)
    v = F.col("value").cast("long")
    value = F.when(v % 3 == 0, F.concat(F.lit("a;b("), F.col("value"), F.lit(")"))).when(v % 3 == 1, F.concat(F.lit("#"), F.col("value"))).when(v % 2 == 0, F.lit(" ")).otherwise(F.lit("null"))
    sym = F.when(F.col("symbol") == "click", "Window.document.cookie").when(F.col("symbol") == "view", "CanvasRenderingContext2D.fillStyle").when(F.col("symbol") == "signup", "CanvasRenderingContext2D.filter").otherwise(F.col("symbol"))
    out = trace.value_features(c.withColumns({"value": value, "symbol": sym}), keep_empty=True)
    return out.select("script", "name", F.array_join("values", "|").alias("feature_values"), F.size("values").cast("long").alias("n_values"))


_ARGS = "string_split(replace(replace(a, '[', ''), ']', ''), ',')"


@query(
    "agg8_argument_features",
    f"""with {CALLS}, a as (select script, seq, symbol, json_extract_string(argument, '$.k')::double as k, value::double as v from calls),
    f as (select script, seq, 'canvasrenderingcontext2d.rect-OnScreen' as name, case when k - 50 >= 0 and v >= 0 then 1.0 else 0.0 end as x from a where symbol = 'click'
      union all select script, seq, 'canvasrenderingcontext2d.rect-Size', k * v from a where symbol = 'click'
      union all select script, seq, 'canvasrenderingcontext2d.arc-OnScreen', case when k - 50 >= 0 and v >= 0 then 1.0 else 0.0 end from a where symbol = 'view'
      union all select script, seq, 'canvasrenderingcontext2d.arc-Size', round(pi() * k * k, 6) from a where symbol = 'view'
      union all select script, seq, 'document.getelementsbytagname', k - 50 from a where symbol = 'error')
    select script, name, seq::bigint as seq, x from (select *, row_number() over (partition by script, name order by seq) as r from f) where r <= 5""",
)
def argument_features(spark, d):
    c = calls(spark, d).withColumn("k", F.get_json_object("argument", "$.k").cast("double"))
    args = F.when(F.col("symbol") == "click", F.concat(F.lit("["), F.col("k") - 50, F.lit(","), F.col("value"), F.lit(","), F.col("k"), F.lit(',"'), F.col("value"), F.lit('"]')))
    args = args.when(F.col("symbol") == "view", F.concat(F.lit("["), F.col("k") - 50, F.lit(","), F.col("value"), F.lit(","), F.col("k"), F.lit("]")))
    args = args.when(F.col("symbol") == "error", F.concat(F.lit('{"0":'), F.col("k") - 50, F.lit("}"))).otherwise(F.lit("not json"))
    sym = F.when(F.col("symbol") == "click", "canvasrenderingcontext2d.rect").when(F.col("symbol") == "view", "canvasrenderingcontext2d.arc").when(F.col("symbol") == "error", "document.getelementsbytagname").otherwise(F.col("symbol"))
    # Values are returned with the place of their call, which first_values keeps the order of.
    full = c.withColumns({"argument": args, "symbol": sym})
    feats = trace.argument_features(full).select("script", "name", F.posexplode("values").alias("pos", "x"))
    order = full.where(F.col("symbol").isin("canvasrenderingcontext2d.rect", "canvasrenderingcontext2d.arc", "document.getelementsbytagname"))
    order = order.select("script", "symbol", "seq", (F.row_number().over(Window.partitionBy("script", "symbol").orderBy("seq")) - 1).alias("pos")).where("pos < 5")
    x = F.col("x").cast("double")
    out = feats.withColumn("symbol", F.regexp_replace("name", "-(OnScreen|Size)$", "")).join(order, ["script", "symbol", "pos"])
    return out.select("script", "name", "seq", F.when(F.col("name").endswith("arc-Size"), F.round(x, 6)).otherwise(x).alias("x"))


@query("agg9_one_hot", f"with {CALLS} select script, name, string_agg(v, ';' order by seq) as vectors from (select script, seq, symbol as name, concat((value::bigint % 4 = 0)::int, ',', (value::bigint % 4 = 1)::int, ',', (value::bigint % 4 = 2)::int) as v, row_number() over (partition by script, symbol order by seq) as k from calls where symbol in ('click', 'view')) where k <= 5 group by all")
def one_hot(spark, d):
    f = calls(spark, d).select("script", "seq", F.col("symbol").alias("name"), (F.col("value").cast("long") % 4).cast("string").alias("value"))
    items = {"click": ["0", "1", "2"], "view": ["0", "1", "2"]}
    rows = F.transform("vectors", lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), ","))
    return trace.one_hot(trace.first_values(f), items).select("script", "name", F.array_join(rows, ";").alias("vectors"))


@query("prj5_arguments", f"with {CALLS} select script, seq::bigint as seq, json_extract_string(argument, '$.k') as k, json_extract_string(argument, '$.k')::double >= 50 as large from calls")
def call_arguments(spark, d):
    k = F.try_element_at(trace.arguments(F.col("argument")), F.lit("k"))
    return calls(spark, d).select("script", "seq", k.alias("k"), (T.number(k) >= 50).alias("large"))


@query("pag3_surface_coverage", "select lower(s.symbol) as symbol, coalesce(c.n, 0)::bigint as n from (values ('Click'), ('view'), ('never'), ('Scroll')) s(symbol) left join (select event_type, count(*) as n from events group by all) c on c.event_type = lower(s.symbol)")
def surface_coverage(spark, d):
    return trace.coverage(calls(spark, d), spark.createDataFrame([("Click",), ("view",), ("never",), ("Scroll",)], "symbol string"))


@query("cat_catalogue_features", f"with {CALLS}, k as (select script, seq, 'value_numeric/click' as name, value::double as v from calls where symbol = 'click' union all select script, seq, 'arguments_length/view', length(argument)::double from calls where symbol = 'view'), r as (select *, row_number() over (partition by script, name order by seq) as r from k) select script, name, sum(v) as total, count(*)::bigint as n from r where r <= 5 group by all")
def catalogue_features(spark, d):
    names = spark.createDataFrame([("Click", "value_numeric"), ("view", "arguments_length")], "name string, family string")
    out = trace.catalogued(calls(spark, d), names).select("script", "name", F.explode("values").alias("v"))
    return out.groupBy("script", "name").agg(F.sum(F.col("v").cast("double")).alias("total"), F.count("*").alias("n"))


# ---- rules and scripts

_CASES = """list_filter([case when regexp_matches(text, 'the |der ') and regexp_matches(text, 'and |und ') and not regexp_matches(text, 'token|@') then 'articles' end,
 case when regexp_matches(text, 'que |les ') and regexp_matches(text, 'de |la ') then 'romance' end,
 case when len(regexp_extract_all(text, '[aeiou]n ')) > 20 and len(regexp_extract_all(text, 'er')) > 20 then 'frequent' end,
 case when regexp_matches(text, '[!#$%]') then 'marked' end], lambda x: x is not null)"""


@query("rule5_categories", f"select doc_id, array_to_string({_CASES}, ';') as categories, (len({_CASES}) > 0)::int as label from documents")
def rule_categories(spark, d):
    c = rules.categories(F.col("text"), TEXT_RULES)
    return table(spark, d, "documents").select("doc_id", F.array_join(c, ";").alias("categories"), rules.label(c).alias("label"))


@query("flt1_categorised_only", f"select count(*)::bigint as n, sum(len(c))::bigint as n_labels from (select {_CASES} as c from documents) where len(c) > 0")
def categorised_only(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("text", "script")
    return rules.categorised(docs, TEXT_RULES).agg(F.count("*").alias("n"), F.sum(F.size("categories")).alias("n_labels"))


@query("rule3_counts", "select doc_id, len(regexp_extract_all(text, 'er'))::bigint as n_er, len(regexp_extract_all(text, '[aeiou]n '))::bigint as n_vn from documents")
def rule_counts(spark, d):
    n = lambda p: T.count_matches(F.col("text"), p).cast("long")
    return table(spark, d, "documents").select("doc_id", n("er").alias("n_er"), n("[aeiou]n ").alias("n_vn"))


SCRIPT_BODY = "(?s)<script[^>]*>(.*?)</script>"


def page_scripts(spark, d):
    found = F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT_BODY), 1)).alias("pos", "script")
    return table(spark, d, "pages").select("page_id", found)


SCRIPTS = f"scripts as (select page_id, unnest(x) as script, unnest(range(len(x))) as pos from (select page_id, regexp_extract_all(html, '{SCRIPT_BODY}', 1) as x from pages))"


@query("prj1_script_flatten", f"with {SCRIPTS} select page_id, pos::bigint as pos, md5(script) as digest, length(script)::bigint as n from scripts where length(script) > 0")
def script_flatten(spark, d):
    return page_scripts(spark, d).where(F.length("script") > 0).select("page_id", F.col("pos").cast("long").alias("pos"), F.md5("script").alias("digest"), F.length("script").cast("long").alias("n"))


@query("prj2_script_strip", "select doc_id, md5(regexp_replace(' \t' || text || '\n ', '^\\s+|\\s+$', '', 'g')) as digest from documents")
def script_strip(spark, d):
    padded = F.concat(F.lit(" \t"), F.col("text"), F.lit("\n "))
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip(padded)).alias("digest"))


@query("prj3_script_clean", "select doc_id, md5(regexp_replace(translate(text, chr(10) || chr(13) || chr(9), '   '), '^\\s+|\\s+$', '', 'g')) as digest from documents")
def script_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_script(F.col("text"))).alias("digest"))


@query("flt2_large_scripts", "select doc_id, octet_length(encode(text))::bigint as bytes, octet_length(encode(text)) > 4000 as too_large from documents")
def large_scripts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), rules.too_large(F.col("text"), 4000).alias("too_large"))


# ---- samples

TARGETS = ["click", "view", "purchase", "error"]


@query("smp1_reservoir", "select doc_id from documents order by md5('s:' || doc_id), doc_id limit 100")
def reservoir_sample(spark, d):
    return sampling.reservoir(table(spark, d, "documents").select("doc_id"), 100, "doc_id")


@query("smp2_stratified", "select event_id, event_type as category from (select *, row_number() over (partition by event_type order by md5('s:' || event_id), event_id) as k from events where event_type in ('click', 'view', 'purchase', 'error')) where k <= 10")
def stratified_sample(spark, d):
    return sampling.stratified(table(spark, d, "events"), F.col("event_type"), TARGETS, 40, "event_id", strict=False).select("event_id", "category")


@query("smp2_first_category", "select event_id, case when event_type in ('view', 'error') then event_type when user_id % 2 = 0 then 'error' end as first_target from events")
def first_category(spark, d):
    cats = F.array(F.col("event_type"), F.when(F.col("user_id") % 2 == 0, "error").otherwise("none"))
    return table(spark, d, "events").select("event_id", sampling.first_category(cats, ["view", "error"]).alias("first_target"))


@query("smp3_repeated", "select rep::int as rep, doc_id, position::bigint as position from (select rep, doc_id, row_number() over (partition by rep order by md5('s:' || rep || ':' || doc_id), doc_id) as position from documents, range(1, 4) r(rep)) where position <= 50")
def repeated_samples(spark, d):
    return sampling.repeated(table(spark, d, "documents").select("doc_id"), 3, 50, "doc_id").select("rep", "doc_id", F.col("position").cast("long").alias("position"))


@query("smp3_two_sources", """with b as (select event_id, null as category from (select event_id from events where event_type = 'signup' order by md5('s1:' || event_id), event_id limit 20)),
 l as (select event_id, event_type as category from (select *, row_number() over (partition by event_type order by md5('s1:' || event_id), event_id) as k from events where event_type in ('click', 'view', 'purchase', 'error')) where k <= 10) select * from b union all select * from l""")
def two_sources(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return sampling.two_sources(e.where("event_type = 'signup'"), e, F.col("event_type"), TARGETS, 20, 40, "event_id").select("event_id", "category")


@query("smp4_balanced", "select doc_id, toxic from (select *, row_number() over (partition by toxic order by md5('s:' || doc_id), doc_id) as k, (select count(*) from labels where toxic = 1) as ones from labels) where toxic = 1 or k <= ones")
def balanced_undersample(spark, d):
    return sampling.balanced(table(spark, d, "labels"), "toxic", "doc_id").select("doc_id", "toxic")


@query("smp5_shuffle", "select doc_id, row_number() over (order by md5('s:' || doc_id), doc_id)::bigint as position from labels")
def shuffle(spark, d):
    return sampling.ranked(table(spark, d, "labels").select("doc_id"), "doc_id", "s", name="position")


@query("ml4_fold_assignment", "select doc_id, ((row_number() over (partition by quality order by md5('fold:' || doc_id), doc_id) - 1) % 10)::int as fold from labels")
def fold_assignment(spark, d):
    return sampling.folds(table(spark, d, "labels"), "quality", "doc_id").select("doc_id", "fold")


@query("ml7_hash_split", "select doc_id, ('0x' || substr(md5('split:' || doc_id), 1, 8))::bigint < 3435973836 as is_train from labels")
def hash_split(spark, d):
    return sampling.hash_split(table(spark, d, "labels"), "doc_id").select("doc_id", "is_train")


# ---- pairs and parts


def sides(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("base"), "lang", F.col("text").alias("content"))
    side = lambda lang: pairing.sizes(docs.where(F.col("lang") == lang), "base")
    return pairing.compared(side("fr"), side("es"))


SIDES = """j as (select source as base, sum(octet_length(encode(text)))::bigint as b from documents where lang = 'fr' group by 1), w as (select source as base, sum(octet_length(encode(text)))::bigint as b from documents where lang = 'es' group by 1),
 c as (select coalesce(j.base, w.base) as base, j.b as js_bytes, w.b as wasm_bytes, case when j.b is null then 'only_wasm' when w.b is null then 'only_js' else 'both' end as status, w.b - j.b as diff, case when j.b = 0 then 'inf'::double else (w.b - j.b) * 100.0::double / j.b end as pct from j full join w on j.base = w.base)"""


@query("agg11_pair_size_compare", f"with {SIDES} select * from c")
def pair_size_compare(spark, d):
    return sides(spark, d)


@query("agg11_size_totals", f"with {SIDES}, t as (select count(*)::bigint as pairs, sum(js_bytes)::bigint as js_bytes, sum(wasm_bytes)::bigint as wasm_bytes from c where status = 'both') select *, wasm_bytes - js_bytes as diff, (wasm_bytes - js_bytes) * 100.0::double / js_bytes as pct from t")
def size_totals(spark, d):
    return pairing.totals(sides(spark, d))


@query("snk9_report", f"with {SIDES} select printf('%-20s %10d %10d %10d %9.2f%%', base, js_bytes, wasm_bytes, diff, pct) as line from c where status = 'both'")
def size_report(spark, d):
    return pairing.report(sides(spark, d))


@query("agg12_combine_parts", "select conv_id as base, count(*)::bigint as parts, md5(string_agg(coalesce(text, ''), chr(10) order by turn)) as digest from conversations group by 1")
def combine_parts(spark, d):
    parts = table(spark, d, "conversations").select(F.lit("js").alias("kind"), F.col("conv_id").alias("base"), F.col("turn").alias("part"), F.coalesce("text", F.lit("")).alias("content"))
    return pairing.combined(parts).select("base", "parts", F.md5("content").alias("digest"))


@query("prj9_part_names", "select 'js_' || source || '_' || doc_id || '.json' as file, 'js' as kind, source as base, doc_id::int as part from documents where doc_id % 2 = 0")
def part_names(spark, d):
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "js").otherwise("css"), F.lit("_"), F.col("source"), F.lit("_"), F.col("doc_id"), F.lit(".json"))
    return pairing.part_names(table(spark, d, "documents").select(name.alias("file")))


@query("prj10_base_name", "select distinct source, 'a_' || source as stem, source as base from documents")
def base_names(spark, d):
    stem = F.concat(F.lit("a_"), F.col("source"))
    return table(spark, d, "documents").select("source", stem.alias("stem"), pairing.base_name(stem).alias("base")).distinct()


@query("src5_last_wins", "select conv_id, max(turn)::bigint as last_turn, max_by(role, turn) as role from conversations group by 1")
def last_wins(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("turn").alias("last_turn"))
    return pairing.last_wins(rows, "conv_id", "turn").select("conv_id", "last_turn", "role")


@query("join2_stage_match", "select doc_id, doc_id in (select doc_id from labels) as is_matched from documents")
def stage_match(spark, d):
    yes, no = pairing.matched(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")
    return yes.withColumn("is_matched", F.lit(True)).unionByName(no.withColumn("is_matched", F.lit(False)))


PAGE_SCRIPT = "(?s)(<script>)(.*?)(</script>)"


@query("join3_page_update", f"select page_id, case when page_id % 3 = 0 then 'missing' when not regexp_matches(html, '{PAGE_SCRIPT}') then 'no_script' else 'updated' end as status, md5(case when page_id % 3 = 0 then html else regexp_replace(html, '{PAGE_SCRIPT}', '\\1$1 new\\3') end) as digest from pages")
def page_update(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("key"), "html")
    twins = p.where("key % 3 <> 0").select("key", F.lit("$1 new").alias("content"))
    return pairing.updated_pages(p, twins).select(F.col("key").alias("page_id"), "status", F.md5("html").alias("digest"))


@query("str9_replace_first", f"select page_id, md5(regexp_replace(html, '{PAGE_SCRIPT}', '\\1NEW\\3')) as digest from pages")
def replace_first(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.replace_first(F.col("html"), PAGE_SCRIPT, F.lit("NEW"))).alias("digest"))


@query("ast18_status_waterfall", """select doc_id, (s = 'abrupt_fail')::int as abrupt_fail, (s = 'time_fail')::int as time_fail, (s = 'ast_fail')::int as ast_fail, (s = 'large_file_skip')::int as large_file_skip, (s = 'validation_fail')::int as validation_fail, (s = 'success')::int as success
 from (select doc_id, case when n_chars * 400 > 800000 then 'large_file_skip' when doc_id % 5 = 0 then 'ast_fail' when doc_id % 7 = 0 then 'abrupt_fail' when n_chars / 2.0 > 600 then 'time_fail' when doc_id % 3 = 0 then 'validation_fail' else 'success' end as s from documents)""")
def status_waterfall(spark, d):
    r = table(spark, d, "documents").selectExpr("doc_id", "n_chars * 400 as bytes", "doc_id % 5 <> 0 as parsed", "cast(doc_id % 7 as int) as n_rules", "n_chars / 2.0 as seconds", "doc_id % 3 <> 0 as valid")
    return pairing.statuses(r).drop("bytes", "parsed", "n_rules", "seconds", "valid")


@query("agg21_log_summary", "select r as rule, count(*)::bigint as runs, sum(doc_id % 2)::bigint as successes from (select doc_id, unnest(string_split('AST' || (doc_id % 4) || '|AST' || (4 + doc_id % 3), '|')) as r from documents) group by 1")
def log_summary(spark, d):
    rules_col = F.expr("concat('AST', doc_id % 4, '|AST', 4 + doc_id % 3)")
    return pairing.log_summary(table(spark, d, "documents").select(rules_col.alias("working_rules"), (F.col("doc_id") % 2).cast("int").alias("success")))


@query("ast16_working_rules", "select conv_id as script, string_agg(role, '|' order by role) as working_rules from (select distinct conv_id, role from conversations where turn % 2 = 0) group by 1")
def working_rules(spark, d):
    checks = table(spark, d, "conversations").select(F.col("conv_id").alias("script"), F.col("role").alias("rule"), (F.col("turn") % 2 == 0).alias("valid"))
    return spans.working_rules(checks)


# ---- spans


def document_spans(spark, d):
    """Three made spans for each document, from its id and length."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.length("text").alias("n"))
    s = lambda a, b, rule: F.struct((F.col("doc_id") * a % F.col("n")).cast("int").alias("start"), F.least(F.col("n"), F.col("doc_id") * a % F.col("n") + b).cast("int").alias("end"), F.lit(rule).alias("rule"), F.lit(0).alias("idx"))
    made = F.array(s(7, 40, 1), s(13, 25, 2), s(29, 60, 3), s(7, 40, 1))
    return rows.withColumn("n", F.nullif("n", F.lit(0))).withColumn("spans", F.when(F.col("n").isNotNull(), made).otherwise(F.array().cast(f"array<{spans.SPAN}>")))


SPANS = """s as (select doc_id, text, length(text) as n, u.r as rule, (doc_id * u.a % length(text))::int as st, least(length(text), doc_id * u.a % length(text) + u.b)::int as en from documents, (values (1, 7, 40), (2, 13, 25), (3, 29, 60)) u(r, a, b) where length(text) > 0),
 o as (select *, row_number() over (partition by doc_id order by st, rule) as k from s),
 t as (select a.doc_id, a.text, a.n, a.st as s1, a.en as e1, b.st as s2, b.en as e2, b.st >= a.en as k2, c.st as s3, c.en as e3, c.st >= case when b.st >= a.en then b.en else a.en end as k3 from o a join o b on a.doc_id = b.doc_id and a.k = 1 and b.k = 2 join o c on c.doc_id = a.doc_id and c.k = 3)"""


@query("seq3_span_cover", f"with {SPANS} select doc_id, 1 + k2::int + k3::int as n_taken, round(((e1 - s1) + case when k2 then e2 - s2 else 0 end + case when k3 then e3 - s3 else 0 end) / n::double, 9) as cnv_ptg from t union all select doc_id, 0, 0.0 from documents where coalesce(length(text), 0) = 0")
def span_cover(spark, d):
    taken = document_spans(spark, d).withColumn("taken", spans.chosen(F.col("spans")))
    return taken.select("doc_id", F.size("taken").alias("n_taken"), F.round(spans.coverage(F.col("taken"), F.col("text")), 9).alias("cnv_ptg"))


@query("seq3_splice", f"with {SPANS} select doc_id, md5(substr(text, 1, s1) || '<>' || case when k2 and k3 then substr(text, e1 + 1, s2 - e1) || '<>' || substr(text, e2 + 1, s3 - e2) || '<>' || substr(text, e3 + 1) when k2 then substr(text, e1 + 1, s2 - e1) || '<>' || substr(text, e2 + 1) when k3 then substr(text, e1 + 1, s3 - e1) || '<>' || substr(text, e3 + 1) else substr(text, e1 + 1) end) as digest from t union all select doc_id, md5(text) from documents where coalesce(length(text), 0) = 0")
def span_splice(spark, d):
    codes = F.create_map(*[x for r in (1, 2, 3) for x in (F.lit(r), F.lit("<>"))])
    taken = document_spans(spark, d).withColumn("taken", spans.chosen(F.col("spans")))
    return taken.select("doc_id", F.md5(spans.spliced(F.col("taken"), F.col("text"), codes)).alias("digest"))


@query("ast15_rule_composition", "select conv_id as script, count(*)::bigint as n_spans from conversations where role = 'user' group by 1")
def rule_composition(spark, d):
    c = table(spark, d, "conversations")
    s = c.select(F.col("conv_id").alias("script"), F.col("role").alias("rule"), F.col("turn").cast("int").alias("start"), (F.col("turn") + 1).cast("int").alias("end"), F.lit(0).alias("idx"))
    checks = c.select(F.col("conv_id").alias("script"), F.col("role").alias("rule"), (F.col("role") == "user").alias("valid"))
    return spans.composed(s, checks).select("script", F.size("spans").cast("long").alias("n_spans"))


@query("ast13_quoted_canvas", """select doc_id, 1 as n_spans, length(text) + 1 as first_start from documents where doc_id % 2 = 0""")
def quoted_canvas(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" 'canvas' + 1"))).otherwise(F.concat("text", F.lit(" \"canvas\" : 1")))
    found = table(spark, d, "documents").select("doc_id", spans.quoted_canvas(t).alias("s")).where(F.size("s") > 0)
    return found.select("doc_id", F.size("s").alias("n_spans"), F.get("s", 0)["start"].cast("long").alias("first_start"))


@query("seq4_offsets", "select doc_id, coalesce(case when len(x) >= 2 and length(x[1]) + 2 <= length(text) then length(x[1]) + 2 end, -1)::bigint as at from (select doc_id, text, string_split(text, chr(10)) as x from documents)")
def offsets(spark, d):
    at = F.coalesce(spans.offset(F.col("text"), F.lit(2), F.lit(1)), F.lit(-1))
    return table(spark, d, "documents").select("doc_id", at.cast("long").alias("at"))


@query("seq5_ordinals", "select conv_id, turn, row_number() over (partition by conv_id order by turn)::bigint as n, ceil(row_number() over (partition by conv_id order by turn) / 3.0)::bigint as part from conversations")
def ordinals(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", n.cast("long").alias("n"), F.ceil(n / 3).cast("long").alias("part"))


# ---- pages and links


@query(
    "htm1_page_links",
    r"""with h as (select page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) as href from pages),
    a as (select page_id, url, href, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as root, regexp_extract(url, '^([^?#]*/)', 1) as folder from h),
    b as (select *, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when starts_with(href, '//') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || href when starts_with(href, '/') then root || href
      when starts_with(href, '#') then regexp_extract(url, '^([^#]*)', 1) || href when starts_with(href, '?') then regexp_extract(url, '^([^?#]*)', 1) || href when href = '' then url when folder = regexp_extract(url, '^([^/]*//)', 1) then root || '/' || href else folder || href end as link from a)
    select page_id, link, count(*)::bigint as n from b where regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) group by all""",
)
def page_links(spark, d):
    links = table(spark, d, "pages").select("page_id", "url", F.explode(urls.hrefs(F.col("html"))).alias("href"))
    links = links.withColumn("link", urls.absolute(F.col("url"), F.col("href")))
    return links.where(urls.authority(F.col("link")) == urls.authority(F.col("url"))).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("prj12_output_key", r"""select page_id, case when p in ('', '/') then 'index' else replace(replace(trim(p, '/'), '/', '_'), '.', '_') end as output_key from (select page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as p from pages)""")
def output_key(spark, d):
    return table(spark, d, "pages").select("page_id", urls.output_key(F.col("url")).alias("output_key"))


@query("url1_authority", r"select page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as authority from pages")
def authority(spark, d):
    return table(spark, d, "pages").select("page_id", urls.authority(F.col("url")).alias("authority"))


@query("pag1_placeholders", """select doc_id, '<canvas id="canvas' || doc_id || '"></canvas>' || chr(10) || '    <div id="' || source || '"></div>' || chr(10) || '    <div class="a"></div>' || chr(10) || '    <div class="' || lang || '"></div>' || chr(10) || '    <p></p>' as html from documents""")
def placeholders(spark, d):
    code = F.concat(
        F.lit("document.getElementById('canvas"), F.col("doc_id"), F.lit("'); document.querySelector(\"#"), F.col("source"), F.lit("\"); document.getElementsByClassName('a "), F.col("lang"),
        F.lit(" a'); document.getElementsByTagName('p'); document.getElementsByTagName('body'); document.getElementById('"), F.col("source"), F.lit("')"),
    )
    return table(spark, d, "documents").select("doc_id", page_functions.placeholders(code).alias("html"))


# ---- tokens and figures


def word_counts(spark, d):
    return tokens.counted(table(spark, d, "documents"), "doc_id", tokens.words(F.col("text")))


WORDS = "w as (select doc_id, token, count(*)::bigint as n from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) as token from documents) group by all)"


@query("agg13_token_frequency", f"with {WORDS} select token, sum(n)::bigint as n from w group by 1 having sum(n) >= 50 or token in ('wh', 'zz')")
def token_frequency(spark, d):
    return tokens.frequent(word_counts(spark, d), 50, ["wh", "zz"])


@query("agg14_token_share", f"with {WORDS} select w.doc_id, token, n from w join (select doc_id, count(*) as kinds from w group by 1) k on k.doc_id = w.doc_id where n >= 0.2 * kinds")
def token_share(spark, d):
    return tokens.dominant(word_counts(spark, d), "doc_id")


@query("top1_tokens", f"with {WORDS} select token, sum(n)::bigint as n from w group by 1 order by n desc, token limit 20")
def top_tokens(spark, d):
    return word_counts(spark, d).groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(20)


@query("join4_token_lookup", "select feature, case when not regexp_matches(feature, '^[0-9]+$') then feature when feature::bigint + 1 <= 20 then 'tok' || (feature::bigint + 1) else '[Unknown token id]' end as token from (select case when doc_id % 4 = 0 then 'f' || doc_id else (doc_id % 50)::varchar end as feature from documents)")
def token_lookup(spark, d):
    ids = table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("f"), F.col("doc_id"))).otherwise((F.col("doc_id") % 50).cast("string")).alias("feature"))
    return tokens.named(ids, spark.range(1, 21).select(F.concat(F.lit("tok"), F.col("id")).alias("token"), F.col("id").alias("idx")))


PREDICTED = "p as (select quality as label, toxic as prediction from labels)"


def predictions(spark, d):
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


@query("agg16_binary_metrics", f"""with {PREDICTED}, c as (select count(*) as n, count(*) filter (where label = 1 and prediction = 1) as tp, count(*) filter (where label <> 1 and prediction = 1) as fp, count(*) filter (where label = 1 and prediction <> 1) as fn, count(*) filter (where label <> 1 and prediction <> 1) as tn from p)
 select n, tp, fp, fn, tn, (tp + tn) / n::double as accuracy, coalesce(tp / nullif(tp + fp, 0)::double, 0.0) as "precision", coalesce(tp / nullif(tp + fn, 0)::double, 0.0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0.0) as f1 from c""")
def binary_metrics(spark, d):
    return metrics.binary(predictions(spark, d))


@query("agg16_class_report", f"""with {PREDICTED}, s as (select label as class, count(*) as support, count(*) filter (where label = prediction) as tp from p group by 1), q as (select prediction as class, count(*) as said from p group by 1)
 select s.class, support, coalesce(tp / nullif(coalesce(said, 0), 0)::double, 0.0) as "precision", tp / support::double as recall, coalesce(2 * tp / nullif(coalesce(said, 0) + support, 0)::double, 0.0) as f1 from s left join q on q.class = s.class""")
def class_report(spark, d):
    return metrics.by_class(predictions(spark, d))


@query("agg17_fold_mean_std", "with f as (select ((row_number() over (partition by quality order by md5('fold:' || doc_id), doc_id) - 1) % 10) as fold, (quality = toxic)::int as hit from labels), a as (select fold, avg(hit) as acc from f group by 1) select round(avg(acc), 9) as mean, round(stddev_pop(acc), 9) as std from a")
def fold_mean_std(spark, d):
    rows = sampling.folds(table(spark, d, "labels"), "quality", "doc_id")
    acc = rows.groupBy("fold").agg(F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("acc"))
    return metrics.over_folds(acc, "acc").select(F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query("agg18_confidence", "select quality as label, round(avg(toxic * 0.5 + 0.25), 9)::double as confidence from labels group by 1")
def mean_confidence(spark, d):
    out = metrics.confidence(table(spark, d, "labels").withColumnRenamed("quality", "label"), F.col("toxic") * 0.5 + 0.25)
    return out.select("label", F.round("confidence", 9).alias("confidence"))


@query("join5_model_by_set", "select m as model, s as dataset, count(*)::bigint as n, avg((case m when 'a' then toxic else 1 - toxic end = quality)::int) as accuracy from labels, (values ('a'), ('b')) x(m), (values (0), (1)) y(s) where doc_id % 2 = s group by all")
def model_by_set(spark, d):
    rows = table(spark, d, "labels").select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), (F.col("doc_id") % 2).cast("int").alias("dataset"))
    p = F.when(F.col("model") == "a", F.col("toxic")).otherwise(1 - F.col("toxic"))
    return metrics.binary(rows.select("model", "dataset", F.col("quality").alias("label"), p.alias("prediction")), "label", "prediction", "model", "dataset").select("model", "dataset", "n", "accuracy")


@query("agg20_run_counters", "select count(*)::bigint as processed, count(*) filter (where n_chars > 4000)::bigint as skipped, count(*) filter (where text not like '%.%')::bigint as unparsable from documents")
def run_counters(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("processed"), F.count_if(F.col("n_chars") > 4000).alias("skipped"), F.count_if(~F.col("text").contains(".")).alias("unparsable"))


# ---- sets, maps, scalars


@query("set1_bag_union", "select kind, count(*)::bigint as n from (select 'd' as kind from documents union all select 'p' from pages) group by 1")
def bag_union(spark, d):
    return table(spark, d, "documents").select(F.lit("d").alias("kind")).unionByName(table(spark, d, "pages").select(F.lit("p").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("set2_key_sets", "select 'both' as side, doc_id from (select doc_id from documents intersect select doc_id from labels) union all select 'only' as side, doc_id from (select doc_id from documents except select doc_id from labels)")
def key_sets(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return a.intersect(b).select(F.lit("both").alias("side"), "doc_id").unionByName(a.subtract(b).select(F.lit("only").alias("side"), "doc_id"))


@query("set3_row_sets", "select conv_id, array_to_string(list_sort(list_distinct(list_concat(list(role), ['x', 'user']))), ',') as united, array_to_string(list_sort(list_filter(list_distinct(list(role)), lambda r: r <> 'user')), ',') as rest from conversations group by 1")
def row_sets(spark, d):
    roles = F.collect_set("role")
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.array_union(roles, F.array(F.lit("x"), F.lit("user")))), ",").alias("united"), F.array_join(F.array_sort(F.array_except(roles, F.array(F.lit("user")))), ",").alias("rest")
    )


@query("str13_halves", "select distinct role, substr(role, 1, length(role) // 2) as a, substr(role, length(role) // 2 + 1) as b from conversations")
def word_halves(spark, d):
    h = T.halves(F.col("role"))
    return table(spark, d, "conversations").select("role", h[0].alias("a"), h[1].alias("b")).distinct()


@query("cst1_numbers", "select event_id, case when event_id % 4 = 0 then value when event_id % 4 = 3 then event_id::double end as x from events")
def numbers(spark, d):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("value").cast("string")).when(k == 1, F.concat("event_id", F.lit("d"))).when(k == 2, F.lit("1_0")).otherwise(F.concat(F.lit(" "), "event_id", F.lit(" ")))
    return table(spark, d, "events").select("event_id", T.number(text).alias("x"))


@query("jsn1_json", "select event_id, json_extract_string(props, '$.k') as k, '{\"k\":' || json_extract_string(props, '$.k') || '}' as again from events")
def json_values(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.cast("long").alias("k"))).alias("again"))


@query("mth1_arithmetic", "select l_orderkey, l_linenumber, round(pi() * l_quantity * l_quantity, 6) as area, case when l_discount = 0 then 'inf'::double else l_tax * 100 / l_discount end as pct from lineitem")
def arithmetic(spark, d):
    # The quotient is one of doubles in the SQL, whatever the columns are; Spark would round that of decimals to a scale.
    pct = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide((F.col("l_tax") * 100).cast("double"), F.col("l_discount").cast("double")))
    area = number_functions.rounded(F.pi() * F.col("l_quantity") * F.col("l_quantity"), 6)  # in the SQL's order: other orders differ in the last bit
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", area.alias("area"), pct.alias("pct"))


@query("str15_stamps", "select event_id, strftime(ts, '%Y%m%d_%H%M%S') as stamp from events")
def stamps(spark, d):
    return table(spark, d, "events").select("event_id", T.stamp(F.col("ts")).alias("stamp"))


# ---- learning: rows only


@query("ml5_rf_bow_eval")
def rf_bow_eval(spark, d):
    from ..operators import learning

    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = docs.select("doc_id", F.col("quality").cast("double").alias("label"), tokens.words(F.col("text")).alias("tokens"))
    split = sampling.hash_split(rows, "doc_id")
    model = learning.fitted(split.where("is_train"))
    return learning.transferred({"bow": model}, {"train": split.where("is_train"), "test": split.where("not is_train")})


@query("ml3_pooled_vectors")
def pooled_vectors(spark, d):
    from ..operators import learning

    rows = table(spark, d, "conversations").select("conv_id", tokens.words(F.coalesce("text", F.lit(""))).alias("tokens"))
    return learning.standardised(learning.pooled(rows, "conv_id", 64)).select("conv_id", F.size(learning.vector_to_array("scaled")).alias("dim"))


# ---- syntax: scripts made of a document's id, for which SQL knows what each rule matches

MADE = "f(); var a{0} = 'x', b = [1, 2]; eval(b); screen.width; for (var i = 0; i < 3; i++) {{ g(i); }} if (a) {{ h(); }} while (b) {{ c.d(); }} class K {{ }} var q = [0.5, 1.5]; var w = \"canvas\";"


def made_scripts(spark, d):
    head, tail = MADE.replace("{{", "{").replace("}}", "}").split("{0}")
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.concat(F.lit(head), F.col("doc_id"), F.lit(tail)).alias("script"))


@query("tok2_tree_features", "select doc_id::varchar as key, 'VariableDeclarator:a' || doc_id as feature, 1::bigint as n from documents union all select doc_id::varchar, 'MemberExpression:screen', 1 from documents")
def tree_features(spark, d):
    from ..operators import script_rules

    f = script_rules.tree_features(made_scripts(spark, d)).select("key", F.explode("features").alias("feature"))
    return f.where(F.col("feature").isin("MemberExpression:screen") | (F.col("feature") == F.concat(F.lit("VariableDeclarator:a"), "key"))).groupBy("key", "feature").agg(F.count("*").alias("n"))
