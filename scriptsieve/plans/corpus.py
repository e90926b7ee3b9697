"""Queries over files, rules, labels and scripts in the corpus's own shapes.

The supplied tables have no scripts, dumps or traces; these are made from the tables' ids, so that each rule, signal and fault occurs and fails to
occur, written as files where the operator reads files, and read again. The SQL says what must come out from the same ids."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import learning, pairing, rules, script_rules, surface, tokens, trace
from ..sources import readers, writers
from ..storage import scratch
from .queries import CALLS, ORACLE_SQL, QUERIES, TEXT_RULES, calls, query, table

__all__ = ["ORACLE_SQL", "QUERIES"]

STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def documents(spark, d):
    return table(spark, d, "documents")


def lit_json(**kinds):
    return F.to_json(F.struct(*[v.alias(k) for k, v in kinds.items()]), {"ignoreNullFields": "false"})


# ---- readers and writers


def dumps(spark, d) -> str:
    """Dump files of 16 groups of documents: each text, a blank one and a missing one; groups 3 and 11 are cut short. Also a file of another name."""
    script = lambda c: F.struct(c.cast("string").alias("script_content"))
    content = F.create_map(F.col("source"), F.array(script(F.col("text")), script(F.lit(" \t\n")), script(F.lit(None))))
    rows = documents(spark, d).groupBy((F.col("doc_id") % 16).alias("file")).agg(F.to_json(F.collect_list(F.struct(content.alias("content")))).alias("content"))
    whole = F.when(F.col("file").isin(3, 11), F.expr("substr(content, 1, length(content) - 7)")).otherwise(F.col("content"))
    root = scratch(spark, "dumps")
    names = F.concat(F.lit("scraped_js_"), "file", F.lit(".json"))
    writers.named_files(rows.select(names.alias("name"), whole.alias("content")), root)
    writers.named_files(rows.where("file = 0").select(F.lit("other.json").alias("name"), "content"), root)
    return root


@query("src1_script_dumps", f"select md5({STRIPPED}) as digest, count(*)::bigint as n from documents where doc_id % 16 not in (3, 11) and length({STRIPPED}) > 0 group by 1")
def script_dumps(spark, d):
    """SRC1, SRC2, SRC3, PRJ1: dumps by pattern, without the malformed ones, flattened to scripts that aren't blank."""
    found = readers.flattened(readers.script_dumps(spark, dumps(spark, d)))
    return found.groupBy(F.md5("script").alias("digest")).agg(F.count("*").alias("n"))


@query("prj1_unstripped_scripts", "select doc_id % 16 in (3, 11) as cut, sum(length(text))::bigint + 3 * count(*) as chars, 2 * count(*)::bigint as n from documents where doc_id % 16 not in (3, 11) group by 1")
def unstripped_scripts(spark, d):
    found = readers.flattened(readers.script_dumps(spark, dumps(spark, d)), stripped=False)
    return found.agg(F.sum(F.length("script")).cast("long").alias("chars"), F.count("*").alias("n")).select(F.lit(False).alias("cut"), "chars", "n")


@query("src2_malformed_dumps", "select 'scraped_js_' || (doc_id % 16) || '.json' as file, count(*)::bigint as documents from documents where doc_id % 16 in (3, 11) group by 1")
def malformed_dumps(spark, d):
    bad = readers.malformed_dumps(spark, dumps(spark, d)).select(F.element_at(F.split("file", "/"), -1).alias("file"))
    docs = documents(spark, d).select(F.concat(F.lit("scraped_js_"), F.col("doc_id") % 16, F.lit(".json")).alias("file"))
    return bad.join(docs, "file").groupBy("file").agg(F.count("*").alias("documents"))


def trace_files(spark, d) -> str:
    """A trace file for each user, in seven folders; of every tenth user it is cut short, of every tenth it has no entries."""
    call = F.struct("seq", "symbol", "argument", "value", (F.col("seq") / 2).alias("timestamp"))
    info = F.transform(F.array_sort(F.collect_list(call)), lambda c: F.struct(c["symbol"].alias("symbol"), c["argument"].alias("argument"), c["value"].alias("value"), c["timestamp"].alias("timestamp")))
    rows = calls(spark, d).groupBy("script").agg(info.alias("information"))
    entry = F.struct("information", F.md5(F.col("script").cast("string")).alias("content_hash"), F.lit(1).alias("crawl_id"))
    content = F.to_json(F.create_map(F.concat(F.lit("h"), "script"), entry))
    content = F.when(F.col("script") % 10 == 0, F.expr("substr(content, 1, length(content) - 3)")).when(F.col("script") % 10 == 7, "{}").otherwise(F.col("content"))
    root = scratch(spark, "traces")
    folder = F.concat(F.lit("run"), F.col("script") % 7, F.lit("/site_"), "script", F.lit("_html.json"))
    writers.named_files(rows.withColumn("content", F.to_json(F.create_map(F.concat(F.lit("h"), "script"), entry))).select(folder.alias("name"), content.alias("content")), root)
    return root


@query(
    "src4_trace_files",
    f"with {CALLS} select 'run' || (script % 7) as folder, script::varchar as script_no, 'h' || script as script_hash, md5(script::varchar) as content_hash, (seq - 1)::int as seq, symbol, argument, value, seq / 2.0::double as ts from calls where script % 10 not in (0, 7)",
)
def read_traces(spark, d):
    """SRC4, SRC6, SRC7, PRJ11, SNK5."""
    return readers.traces(spark, trace_files(spark, d))


@query("src7_trace_faults", "select distinct 'run' || (user_id % 7) as folder, 'site_' || user_id || '_html.json' as file, case user_id % 10 when 0 then 'not JSON' else 'no entries' end as reason from events where user_id % 10 in (0, 7)")
def trace_faults(spark, d):
    return readers.trace_faults(spark, trace_files(spark, d))


def keyed(spark, d) -> str:
    """A list of objects for each conversation, whose keys are turns by threes, so that some come again; even conversations hold one object."""
    t = table(spark, d, "conversations").where("conv_id % 2 = 1 or turn = 0")
    item = F.struct("turn", F.create_map(F.concat(F.lit("k"), F.col("turn") % 3), F.struct(F.col("role").alias("label"), F.coalesce("text", F.lit("")).alias("content"))).alias("o"))
    rows = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.to_json(item["o"]).alias("o")))), lambda x: x["o"]).alias("objects"))
    one = F.get("objects", 0)
    listed = F.concat(F.lit("["), F.array_join("objects", ", "), F.lit("]"))
    root = scratch(spark, "keyed")
    writers.named_files(rows.select(F.concat(F.lit("items_"), "conv_id", F.lit(".json")).alias("name"), F.when(F.col("conv_id") % 2 == 1, listed).otherwise(one).alias("content")), root)
    writers.one_file_a_row(rows.select(F.col("conv_id").alias("key"), one.alias("content")), root)  # of another name
    return root


@query("src5_keyed_items", "select 'items_' || conv_id || '.json' as file, 'k' || (turn % 3) as key, max_by(role, turn) as label, md5(max_by(coalesce(text, ''), turn)) as digest from conversations where conv_id % 2 = 1 or turn = 0 group by all")
def keyed_items(spark, d):
    """SRC5, SRC6, PRJ13."""
    found = readers.keyed_items(spark, keyed(spark, d), pattern="items_*.json")
    return found.select(F.element_at(F.split("file", "/"), -1).alias("file"), "key", "label", F.md5("content").alias("digest"))


@query("src8_html_pages", "select page_id::varchar as key, md5(coalesce(html, '')) as digest from pages")
def html_pages(spark, d):
    """SRC8, SNK10: a file a page, and back."""
    root = scratch(spark, "pages")
    writers.one_file_a_row(table(spark, d, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("content")), root, ".html")
    return readers.html_pages(spark, root).select("key", F.md5("html").alias("digest"))


@query("src9_sequences", "select doc_id % 2 as label, count(*)::bigint as n, sum(3 * doc_id + 3)::bigint as total from documents group by 1")
def sequences(spark, d):
    path = scratch(spark, "sequences")
    ids = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (F.col("doc_id") + k).cast("int"))
    documents(spark, d).select((F.col("doc_id") % 2).cast("double").alias("label"), ids.alias("seq")).write.parquet(path)
    found = readers.sequences(spark, path)
    return found.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), F.sum(F.aggregate("seq", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


@query("src10_vocabulary", "select n_name as token, n_nationkey::int as idx from nation")
def vocabulary(spark, d):
    root = scratch(spark, "vocabulary")
    pairs = F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))
    writers.named_files(table(spark, d, "nation").agg(F.to_json(pairs).alias("content")).select(F.lit("words.json").alias("name"), "content"), root)
    return readers.vocabulary(spark, root)


TEXT_CATEGORIES = """list_filter([case when regexp_matches(text, 'the |der ') and regexp_matches(text, 'and |und ') and not regexp_matches(text, 'token|@') then 'articles' end,
 case when regexp_matches(text, 'que |les ') and regexp_matches(text, 'de |la ') then 'romance' end,
 case when len(regexp_extract_all(text, '[aeiou]n ')) > 20 and len(regexp_extract_all(text, 'er')) > 20 then 'frequent' end,
 case when regexp_matches(text, '[!#$%]') then 'marked' end], lambda x: x is not null)"""


def categorised(spark, d):
    """Texts with quotes, commas and line ends, and their categories."""
    marked = F.concat(F.lit('say "'), "text", F.lit('", then\n'), F.col("doc_id"))
    return rules.categorised(documents(spark, d).withColumnRenamed("text", "script"), TEXT_RULES).withColumnRenamed("script", "text").withColumn("script", marked)


QUOTED_TEXT = "'say \"' || text || '\", then' || chr(10) || doc_id"


@query("src11_categorised_csv", f"select md5({QUOTED_TEXT}) as digest, array_to_string({TEXT_CATEGORIES}, '+') as categories from documents where len({TEXT_CATEGORIES}) > 0")
def categorised_csv(spark, d):
    """SRC11, SNK3: quoted CSV, and back."""
    path = scratch(spark, "csv")
    writers.quoted_csv(categorised(spark, d), path)
    return readers.categorised_csv(spark, path).select(F.md5("script").alias("digest"), F.array_join("categories", "+").alias("categories"))


@query("snk1_json_lines", f"select doc_id % 3 as part, md5({QUOTED_TEXT}) as digest, array_to_string({TEXT_CATEGORIES}, '+') as categories from documents where len({TEXT_CATEGORIES}) > 0 and doc_id % 5 <> 0")
def json_lines(spark, d):
    """SNK1, SNK2, FLT4: JSON lines, and back; rows whose categories are no list are left out."""
    path = scratch(spark, "json")
    rows = categorised(spark, d).select((F.col("doc_id") % 3).alias("part"), "script", F.to_json("categories").alias("c"), "doc_id")
    line = lit_json(script=F.col("script"), categories=F.col("categories"))
    writers.json_lines(rows.where("doc_id % 5 <> 0").select("part", "script", F.from_json("c", "array<string>").alias("categories")), path, "part")
    bad = rows.where("doc_id % 5 = 0").select("part", "script", F.col("c").alias("categories"))
    bad.select("part", line.alias("value")).write.mode("append").partitionBy("part").text(path)
    return readers.categorised_json(spark, path, lines=True, pattern="part*").select(F.col("part").cast("long").alias("part"), F.md5("script").alias("digest"), F.array_join("categories", "+").alias("categories"))


@query("src3_json_arrays", f"select md5({QUOTED_TEXT}) as digest, count(*)::bigint as n from documents where len({TEXT_CATEGORIES}) > 0 group by 1")
def json_arrays(spark, d):
    root = scratch(spark, "arrays")
    rows = categorised(spark, d).groupBy((F.col("doc_id") % 9).alias("file")).agg(F.to_json(F.collect_list(F.struct("script", "categories"))).alias("content"))
    writers.named_files(rows.select(F.concat(F.lit("a"), "file", F.lit(".json")).alias("name"), "content"), root)
    return readers.categorised_json(spark, root).groupBy(F.md5("script").alias("digest")).agg(F.count("*").alias("n"))


@query("snk4_wide_csv", f"""with {CALLS}, f as (select script, symbol, '[' || string_agg('"' || value || '"', ',' order by seq) || ']' as cell from (select *, row_number() over (partition by script, symbol order by seq) as k from calls) where k <= 5 group by all)
 select script::varchar as script, max(case symbol when 'click' then cell end) as click, max(case symbol when 'view' then cell end) as view, max(case symbol when 'never' then cell end) as never from f group by 1""")
def wide_csv(spark, d):
    """SNK4, SET5: one column a feature."""
    path = scratch(spark, "wide")
    found = trace.first_values(calls(spark, d).select("script", "seq", F.col("symbol").alias("name"), "value"))
    writers.wide_csv(found, path, ["click", "view", "never"])
    return spark.read.option("header", True).option("escape", "\\").schema("script string, click string, view string, never string").csv(path)


@query("set5_column_union", "select case when doc_id % 2 = 0 then doc_id end as a, case when doc_id % 2 = 1 then source end as b, count(*)::bigint as n from documents group by all")
def column_union(spark, d):
    docs = documents(spark, d)
    both = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("a")).unionByName(docs.where("doc_id % 2 = 1").select(F.col("source").alias("b")), allowMissingColumns=True)
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("snk6_append_log", "select source, count(*)::bigint as n from documents group by 1 union all select lang, count(*) from documents group by 1")
def append_log(spark, d):
    path = scratch(spark, "log")
    for c in ("source", "lang"):
        writers.append_log(documents(spark, d).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")), path)
    return spark.read.option("header", True).schema("source string, n long").csv(path).withColumn("source", F.nullif("source", F.lit("")))


@query("snk7_batches", "select case when doc_id % 4 = 0 then 'wasm' else 'js' end as kind, count(*)::bigint as n, sum(doc_id)::bigint as ids, true as within from documents group by 1")
def checkpoint_batches(spark, d):
    path = scratch(spark, "batches")
    kind = F.when(F.col("doc_id") % 4 == 0, "wasm").otherwise("js")
    writers.batches(documents(spark, d).select(kind.alias("kind"), "doc_id"), path, 50)
    rows = spark.read.schema("doc_id long, kind string").json(path).withColumn("file", F.col("_metadata.file_path"))
    files = rows.groupBy("kind", "file").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
    return files.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), (F.max("n") <= 50).alias("within"))


@query("snk8_by_kind_and_base", "select case when doc_id % 4 = 0 then 'wasm' else 'js' end as kind, source as base, count(*)::bigint as n, sum(doc_id)::bigint as ids from documents group by all")
def by_kind_and_base(spark, d):
    path = scratch(spark, "bases")
    kind = F.when(F.col("doc_id") % 4 == 0, "wasm").otherwise("js")
    writers.by_kind_and_base(documents(spark, d).select(kind.alias("kind"), F.col("source").alias("base"), "doc_id"), path)
    return spark.read.schema("doc_id long, kind string, base string").json(path).groupBy("kind", "base").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("snk8_part_files", "select 'js' as kind, 'conv' || conv_id as base, (turn + 1)::int as part, 's' || turn as script_no, (turn % 2)::int as label, md5(coalesce(text, '')) as digest from conversations")
def part_files(spark, d):
    """Part files named by kind, base and number, and back."""
    root = scratch(spark, "parts")
    t = table(spark, d, "conversations")
    content = F.to_json(F.create_map(F.concat(F.lit("s"), "turn"), F.struct((F.col("turn") % 2).cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("content"))))
    writers.named_files(t.select(F.concat(F.lit("js_conv"), "conv_id", F.lit("_"), F.col("turn") + 1, F.lit(".json")).alias("name"), content.alias("content")), root)
    found = readers.converted_parts(spark, root)
    return found.select("kind", "base", "part", "script_no", "label", F.md5("content").alias("digest"))


@query("snk5_nested", "select doc_id, '{\"doc_id\":' || doc_id || ',\"inner\":{\"lang\":\"' || lang || '\",\"odd\":' || (doc_id % 2) || '}}' as value from documents")
def nested(spark, d):
    inner = F.struct("lang", (F.col("doc_id") % 2).alias("odd"))
    value = writers.nested(documents(spark, d).select("doc_id", inner.alias("inner")))
    return value.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "value")


@query("snk11_samples", "select 'sample_' || rep || '_20240102_030405.json' as file, doc_id from (select rep, doc_id, row_number() over (partition by rep order by md5('s:' || rep || ':' || doc_id), doc_id) as k from documents, range(1, 4) r(rep)) where k <= 20")
def sample_files(spark, d):
    from ..operators import sampling

    root = scratch(spark, "samples")
    writers.samples(sampling.repeated(documents(spark, d).select("doc_id"), 3, 20, "doc_id").select("rep", "doc_id"), root, "sample", "20240102_030405")
    rows = spark.read.schema("doc_id long").option("multiLine", True).json(root)
    return rows.select(F.col("_metadata.file_name").alias("file"), "doc_id")


@query("snk12_model", "select distinct d.source, k.idx from documents d join (select source, (row_number() over (order by count(*) desc, source) - 1)::double as idx from documents where source is not null group by source) k using (source)")
def saved_model(spark, d):
    path = scratch(spark, "model")
    rows = documents(spark, d).select("source").where("source is not null")
    writers.model(Pipeline(stages=[StringIndexer(inputCol="source", outputCol="idx")]).fit(rows), path)
    return PipelineModel.load(path).transform(rows).distinct()


@query("srt1_sorted_report", "select row_number() over (order by base)::bigint as place, base, parts from (select source as base, count(*)::bigint as parts from documents group by 1)")
def sorted_report(spark, d):
    """SRT1, SRT2: places in the sorted order, as the report has them."""
    rows = documents(spark, d).groupBy(F.col("source").alias("base")).agg(F.count("*").alias("parts")).orderBy("base")
    return rows.agg(F.collect_list(F.struct("base", "parts")).alias("r")).select(F.posexplode("r").alias("place", "r")).select((F.col("place") + 1).cast("long").alias("place"), "r.base", "r.parts")


# ---- the four script rules: texts that hit and miss each clause by id


def bit(expression: str, text: str) -> F.Column:
    return F.when(F.expr(expression), F.lit(text)).otherwise(F.lit(""))


def rule_scripts(spark, d):
    parts = [
        bit("doc_id % 2 = 0", "c.fillText(a);"), bit("doc_id % 6 = 1", "c.strokeText(a);"), bit("doc_id % 3 < 2", "c.fillStyle = b;"), bit("doc_id % 5 < 4", "e.toDataURL();"), bit("doc_id % 7 = 0", "c.restore();"), bit("doc_id % 11 = 0", "e.addEventListener(f);"),
        bit("doc_id % 4 = 0", "p.createOffer(f);"), bit("doc_id % 9 = 5", "p.createDataChannel(n);"), bit("doc_id % 6 < 3", "p.onicecandidate = f;"),
        F.expr("repeat('c.font\t = g;', cast(18 + doc_id % 5 as int))"), F.expr("repeat('c.measureText(t);', cast(19 + doc_id % 4 as int))"),
        bit("doc_id % 10 = 3", "o.createOscillator();"), bit("doc_id % 10 = 4", "o.createDynamicsCompressor();"), bit("doc_id % 3 = 0", "o.startRendering();"),
    ]
    return documents(spark, d).select("doc_id", F.concat(*parts).alias("script"))


RULED = """r as (select doc_id, (doc_id % 2 = 0 or doc_id % 6 = 1) and doc_id % 3 < 2 and doc_id % 5 < 4 and doc_id % 7 <> 0 and doc_id % 11 <> 0 as is_canvas,
  (doc_id % 4 = 0 or doc_id % 9 = 5) and doc_id % 6 < 3 as is_webrtc, 18 + doc_id % 5 > 20 and 19 + doc_id % 4 > 20 as is_font, doc_id % 10 in (3, 4) and doc_id % 3 = 0 as is_audio from documents)"""
LABELS = """list_filter([case when is_canvas then 'Canvas Fingerprinting' end, case when is_webrtc then 'WebRTC Fingerprinting' end, case when is_font then 'Canvas Font Fingerprinting' end, case when is_audio then 'AudioContext Fingerprinting' end], lambda x: x is not null)"""


@query("rule1_script_vocabulary", f"with {RULED} select *, array_to_string({LABELS}, ';') as categories, (len({LABELS}) > 0)::int as label from r")
def script_vocabulary(spark, d):
    """RULE1 to RULE5: each rule's verdict and the categories in their order."""
    c = rules.categories(F.col("script"))
    each = [r.column(F.col("script")).alias(n) for n, r in zip(("is_canvas", "is_webrtc", "is_font", "is_audio"), rules.SCRIPT_RULES)]
    return rule_scripts(spark, d).select("doc_id", *each, F.array_join(c, ";").alias("categories"), rules.label(c).alias("label"))


@query("rule5_category_counts", f"with {RULED} select category, count(*)::bigint as n from (select unnest({LABELS}) as category from r) group by 1")
def category_counts(spark, d):
    return rules.categorised(rule_scripts(spark, d)).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


# ---- labels of traces: calls that give and withhold each signal by id


def labelled_calls(spark, d):
    call = lambda symbol, value=None: F.struct(F.lit(symbol).alias("symbol"), (F.lit(None) if value is None else value).cast("string").alias("value"))
    some = lambda expression, *c: F.when(F.expr(expression), F.array(*c)).otherwise(F.array().cast("array<struct<symbol:string,value:string>>"))
    many = lambda n, fn: F.transform(F.sequence(F.lit(1), F.expr(n).cast("int")), fn)
    two = "CanvasRenderingContext2D"
    parts = [
        some("doc_id % 2 = 0", call(f" {two}.fillText ")), some("doc_id % 3 < 2", call(f"{two}.strokeStyle", F.lit("#fff"))), some("doc_id % 5 < 4", call("HTMLCanvasElement.toDataURL")),
        some("doc_id % 7 = 0", call(f"{two}.SAVE")), some("doc_id % 13 = 0", call(f"{two}.saveAll")),
        some("doc_id % 4 = 0", call("RTCPeerConnection.createOffer")), some("doc_id % 6 < 3", call("RTCPeerConnection.onicecandidate")), some("doc_id % 6 = 4", call("RTCPeerConnection.onicecandidates")),
        many("18 + doc_id % 5", lambda k: F.struct(F.lit(f"{two}.font").alias("symbol"), F.concat(k, F.lit("px")).alias("value"))), some("doc_id % 2 = 1", call(f"{two}.font"), call(f"{two}.font")),
        many("19 + doc_id % 4", lambda k: F.struct(F.lit(f"{two}.measureText").alias("symbol"), k.cast("string").alias("value"))),
        some("doc_id % 11 = 0", call("OfflineAudioContext.startRendering")), some("doc_id % 11 = 1", call("OfflineAudioContext.length")), some("doc_id % 3 = 0", F.struct(F.lit(None).cast("string").alias("symbol"), F.lit("x").alias("value"))),
    ]
    rows = documents(spark, d).select(F.col("doc_id").alias("script"), F.posexplode(F.concat(*parts)).alias("seq", "c"))
    return rows.select("script", F.col("seq").cast("long").alias("seq"), "c.symbol", F.lit(None).cast("string").alias("argument"), "c.value")


LABELLED = """l as (select doc_id as script, doc_id % 2 = 0 and doc_id % 3 < 2 and doc_id % 5 < 4 and doc_id % 7 <> 0 as is_canvas, doc_id % 4 = 0 and doc_id % 6 < 3 as is_webrtc,
  18 + doc_id % 5 + doc_id % 2 > 20 and 19 + doc_id % 4 > 20 as is_canvasfont, doc_id % 11 = 0 as is_audio from documents)"""


@query("rule6_ground_truth_labels", f"with {LABELLED} select *, is_canvas or is_webrtc or is_canvasfont or is_audio as is_fingerprinting from l")
def ground_truth_labels(spark, d):
    """AGG3 to AGG6."""
    return trace.ground_truth(labelled_calls(spark, d))


@query("rule6_label_counts", f"with {LABELLED} select is_canvas, is_webrtc, is_canvasfont, is_audio, count(*)::bigint as scripts from l group by all")
def label_counts(spark, d):
    return trace.ground_truth(labelled_calls(spark, d)).groupBy("is_canvas", "is_webrtc", "is_canvasfont", "is_audio").agg(F.count("*").alias("scripts"))


_TWO = "canvasrenderingcontext2d"
_CALLED = {
    f"{_TWO}.filltext": "sum((doc_id % 2 = 0)::int)", f"{_TWO}.strokestyle": "sum((doc_id % 3 < 2)::int)", "htmlcanvaselement.todataurl": "sum((doc_id % 5 < 4)::int)", f"{_TWO}.save": "sum((doc_id % 7 = 0)::int)",
    "rtcpeerconnection.createoffer": "sum((doc_id % 4 = 0)::int)", "rtcpeerconnection.onicecandidate": "sum((doc_id % 6 < 3)::int)", f"{_TWO}.font": "sum(18 + doc_id % 5 + 2 * (doc_id % 2))",
    f"{_TWO}.measuretext": "sum(19 + doc_id % 4)", "offlineaudiocontext.startrendering": "sum((doc_id % 11 = 0)::int)",
}


@query("pag3_hooked_surface", " union all ".join(f"select '{s}' as symbol, {_CALLED.get(s, 'sum(0)')}::bigint as n from documents" for s in surface.symbols()))
def hooked_surface(spark, d):
    """PAG3: how often each symbol of the whole hooked surface was called."""
    return trace.coverage(labelled_calls(spark, d), surface.surface(spark))


@query("pag5_hook_semantics", "select event_id, case event_id % 4 when 0 then 'method' when 1 then 'getter' when 2 then 'setter' else 'method' end as kind from events")
def hook_semantics(spark, d):
    arguments = F.expr("case event_id % 4 when 0 then '[1, 2]' when 1 then '{}' when 2 then '[\"x\"]' else '[]' end")
    value = F.when(F.col("event_id") % 4 != 2, "v")
    return table(spark, d, "events").select("event_id", trace.hook_kind(arguments, value).alias("kind"))


# ---- scripts whose statements repeat by id, so that the SQL can count and place what each rule matches

#: Statements; each occurs (doc_id // its place) % 4 times, in this order, after a head.
STATEMENTS = (
    "var a = 'x';\n", "eval(b, 'y', 1 + 2);\n", "var c = [1, true, -3];\n", "var q = [0.5, 1.5];\n", "class K { m() { return 1; } }\n", "function g(x) { var h = (y) => y; }\n", "if (a) { d = 1; } else { e(); }\n",
    "for (var i = 0; i < 3; i++) { }\n", "while (b < k.l) { }\n", "f();\n", "x.y = o['z'];\n", "t = screen.width;\n", "w = \"canvas\" + '\\\\';\n", "v = { \"canvas\": canvas.height };\n", "if (a) { for (;;) { break; } }\n",
)
HEADS = ("/* */ ", "function outer(s) { ")
#: What the rules match in each statement: (statement, rule, start, length), and what the heads add.
HITS = (
    (0, 1, 0, 12), (1, 2, 0, 19), (1, 10, 0, 20), (2, 3, 0, 22), (3, 4, 0, 19), (4, 5, 0, 29), (5, 6, 0, 35), (5, 6, 24, 8), (6, 7, 0, 31), (6, 10, 25, 4), (7, 8, 0, 31), (8, 9, 0, 19), (8, 11, 13, 1),
    (9, 10, 0, 4), (10, 11, 2, 1), (10, 11, 9, 1), (11, 11, 11, 5), (11, 12, 4, 12), (11, 14, 4, 6), (12, 13, 4, 8), (13, 11, 23, 6), (13, 14, 16, 6), (4, 6, 11, 16),
)
PLACES = ", ".join(f"({k}, {len(s)})" for k, s in enumerate(STATEMENTS))
MADE = f"""st as (select * from (values {PLACES}) v(k, len)), cn as (select doc_id, k, len, (doc_id // (k + 1)) % 4 as c from documents, st),
 pl as (select doc_id, k, c, len, (case when doc_id % 2 = 1 then {len(HEADS[1])} else {len(HEADS[0])} end + coalesce(sum(c * len) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0))::bigint as pos from cn)"""


def made_scripts(spark, d):
    parts = [F.expr(f"repeat('{s}', cast((doc_id div {k + 1}) % 4 as int))") if "'" not in s else F.repeat(F.lit(s), F.expr(f"cast((doc_id div {k + 1}) % 4 as int)")) for k, s in enumerate(STATEMENTS)]
    odd = F.col("doc_id") % 2 == 1
    return documents(spark, d).select(F.col("doc_id").alias("key"), F.concat(F.when(odd, HEADS[1]).otherwise(HEADS[0]), *parts, F.when(odd, "}").otherwise("")).alias("script"))


@query(
    "ast_rule_spans",
    f"""with {MADE}, h as (select * from (values {", ".join(map(str, HITS))}) v(k, rule, start, len)),
    f as (select doc_id, rule, c as n, pos + h.start as first_start, pos + (c - 1) * pl.len + h.start + h.len as last_end, c * h.len as covered from pl join h using (k) where c > 0
      union all select doc_id, 6, 1, 0, {len(HEADS[1])} + (select sum(c * len) from cn where cn.doc_id = documents.doc_id) + 1, {len(HEADS[1])} + (select sum(c * len) from cn where cn.doc_id = documents.doc_id) + 1 from documents where doc_id % 2 = 1)
    select doc_id::varchar as key, rule::int as rule, sum(n)::bigint as n_spans, min(first_start)::bigint as first_start, max(last_end)::bigint as last_end, sum(covered)::bigint as covered from f group by all""",
)
def rule_spans(spark, d):
    """AST1 to AST14: how many spans of each rule, where the first starts and the last ends, and how much they cover."""
    out = script_rules.match_rules(made_scripts(spark, d))
    figures = [F.count("*").alias("n_spans"), F.min("start").cast("long").alias("first_start"), F.max("end").cast("long").alias("last_end"), F.sum(F.col("end") - F.col("start")).alias("covered")]
    return out.groupBy("key", "rule").agg(*figures)


@query("ast17_parse_check", "select doc_id::varchar as key, doc_id % 3 <> 0 and doc_id % 5 <> 1 as parsed from documents")
def parse_check(spark, d):
    faulty = F.when(F.col("key") % 3 == 0, F.concat("script", F.lit(" var = ("))).when(F.col("key") % 5 == 1, F.concat(F.lit("{ "), "script")).otherwise(F.concat("script", F.expr("repeat('(function () { ', 300)"), F.expr("repeat('})();', 300)")))
    return script_rules.parse_checks(made_scripts(spark, d).withColumn("script", faulty))


@query("ast19_arguments", "select doc_id::varchar as key, 2 as rule, 'v' || doc_id || ',''x'',complex_expression' as said from documents union all select doc_id::varchar, 9, 'a' || (doc_id % 3) || ',k,z' || doc_id from documents")
def call_arguments(spark, d):
    """AST19, AST20: arguments of a call, names in a test."""
    script = F.concat(F.lit("/**/ eval(v"), "doc_id", F.lit(", 'x', 1 + "), "doc_id", F.lit("); while (z"), "doc_id", F.lit(" < k.l[a"), F.col("doc_id") % 3, F.lit("] && z"), "doc_id", F.lit(") { }"))
    found = script_rules.match_rules(documents(spark, d).select(F.col("doc_id").alias("key"), script.alias("script"))).where(F.col("rule").isin(2, 9))
    return found.select("key", "rule", F.coalesce(F.try_element_at("attrs", F.lit("arguments")), F.try_element_at("attrs", F.lit("names"))).alias("said"))


#: Tokens of each statement and head, by hand.
TOKENS = (
    "var a = 'x' ;", "eval ( b , 'y' , 1 + 2 ) ;", "var c = [ 1 , true , - 3 ] ;", "var q = [ 0.5 , 1.5 ] ;", "class K { m ( ) { return 1 ; } }", "function g ( x ) { var h = ( y ) => y ; }", "if ( a ) { d = 1 ; } else { e ( ) ; }",
    "for ( var i = 0 ; i < 3 ; i ++ ) { }", "while ( b < k . l ) { }", "f ( ) ;", "x . y = o [ 'z' ] ;", "t = screen . width ;", "w = \"canvas\" + '\\\\' ;", "v = { \"canvas\" : canvas . height } ;", "if ( a ) { for ( ; ; ) { break ; } }",
)
HEAD_TOKENS = ("", "function outer ( s ) {")
_TOKEN_ROWS = ", ".join(f"({k}, '{' '.join(t.split()).replace(chr(39), chr(39) * 2)}', {len(t.split())})" for k, t in enumerate(TOKENS))


@query(
    "tok1_script_tokens",
    f"""with {MADE}, t as (select * from (values {_TOKEN_ROWS}) v(k, said, n)), j as (select doc_id, string_agg(trim(repeat(said || ' ', c::int)), ' ' order by k) filter (where c > 0) as body, coalesce(sum(c * n), 0)::bigint as n from pl join t using (k) group by 1)
    select doc_id::varchar as key, n + case when doc_id % 2 = 1 then 7 else 0 end as n_tokens, md5(array_to_string(list_filter([case when doc_id % 2 = 1 then '{HEAD_TOKENS[1]}' end, body, case when doc_id % 2 = 1 then '}}' end], lambda x: x is not null), ' ')) as digest from j""",
)
def script_tokens(spark, d):
    """TOK1: the lexer's tokens, in order."""
    t = tokens.script_tokens(F.col("script"))
    return made_scripts(spark, d).select(F.col("key").cast("string").alias("key"), F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("tok3_statement_features", """with b as (select doc_id, ['If: Identifier: p' || doc_id, 'If: Literal: 1', 'If: Unknown Statement'] as f from documents)
 select doc_id::varchar as key, case doc_id % 3 when 0 then f[1] when 1 then f[1] || '|' || f[2] else f[1] || '|' || f[3] end as features from b""")
def statement_features(spark, d):
    other = F.when(F.col("doc_id") % 3 == 0, F.lit("q = 1;")).when(F.col("doc_id") % 3 == 1, F.lit("if (1) { r(); }")).otherwise(F.lit("if (a < b) { r(); }"))
    scripts = documents(spark, d).select(F.col("doc_id").alias("key"), F.concat(F.lit("if (p"), "doc_id", F.lit(") { s = 2; } "), other).alias("script"))
    return script_rules.tree_features(scripts, top_level=True).select("key", F.array_join("features", "|").alias("features"))


@query("tok4_hashed_vectors", "select doc_id, 256 as size, len(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'))::double as total from documents")
def hashed_vectors(spark, d):
    rows = documents(spark, d).select("doc_id", tokens.words(F.col("text")).alias("tokens"))
    v = learning.vector_to_array("features")
    return learning.hashed(rows).select("doc_id", F.size(v).alias("size"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


# ---- maps, links, vocabularies


@query("map1_merge_invert", """with c as (select user_id, event_type, count(*)::bigint as n from events group by all), m as (select user_id, event_type as k, n from c union all select user_id, 'extra', 0 from c group by 1),
 i as (select user_id, n, max(k) as k from m group by all) select user_id, string_agg(n || '=' || k, ',' order by n) as inverted, (select count(*) from m where m.user_id = i.user_id)::bigint as n_keys from i group by 1""")
def map_merge(spark, d):
    """Counts by type, merged with a default and inverted; of types with one count the last by name stays."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    merged = F.array_append(F.collect_list(F.struct(F.col("event_type").alias("k"), "n")), F.struct(F.lit("extra").alias("k"), F.lit(0).cast("long").alias("n")))
    rows = n.groupBy("user_id").agg(F.map_from_entries(merged).alias("m"))
    turned = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))))
    last = F.filter(turned, lambda x, i: F.coalesce(F.get(turned, i + 1)["n"] != x["n"], F.lit(True)))
    inverted = F.map_from_entries(last)
    said = F.array_join(F.transform(F.map_entries(inverted), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",")
    return rows.select("user_id", said.alias("inverted"), F.size("m").cast("long").alias("n_keys"))


FORMS = ("../x", "./y/", "a/../b?q=../z", "../../../up", "?w=1", "#f", "//o/y/../z", "/r/../s/.", "http://o/./x", "", "c/d/..", "mailto:a@b", "e/./f#../g")


@query(
    "join6_absolute_links",
    "with f as (select * from (values "
    + ", ".join(f"('{f}')" for f in FORMS)
    + r""") v(href)), b as (select page_id, url, href, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as root, regexp_extract(url, '^([^?#]*)', 1) as bare from pages, f),
    w as (select *, case when starts_with(href, '/') then '' when length(bare) = length(root) then '/' else regexp_extract(substr(bare, length(root) + 1), '^(.*/)', 1) end || regexp_extract(href, '^([^?#]*)', 1) as way, regexp_extract(href, '^[^?#]*(.*)$', 1) as rest from b),
    n as (select *, list_reduce(list_prepend('', string_split(way, '/')[2:]), lambda a, x: case x when '.' then a when '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || x end) || case when string_split(way, '/')[-1] in ('.', '..') then '/' else '' end as walked from w)
    select page_id, href, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when starts_with(href, '//') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || href when href = '' then url
      when starts_with(href, '#') then regexp_extract(url, '^([^#]*)', 1) || href when starts_with(href, '?') then bare || href else root || walked || rest end as link from n""",
)
def absolute_links(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, FORMS))).alias("href"))
    return rows.select("page_id", "href", urls.absolute(F.col("url"), F.col("href")).alias("link"))


@query("htm1_href_forms", "select page_id, string_agg(h, ' ' order by k) as hrefs from (select page_id, unnest(['d' || page_id, 's' || page_id, 'b' || page_id]) as h, unnest([1, 2, 3]) as k from pages) group by 1")
def href_forms(spark, d):
    html = F.concat(F.lit("<a href=\"d"), "page_id", F.lit("\">x</a><A class='c' HREF = 's"), "page_id", F.lit("'>y</A><a data-href=n href=b"), "page_id", F.lit(">z</a><abbr href='no'>"))
    return table(spark, d, "pages").select("page_id", F.array_join(urls.hrefs(html), " ").alias("hrefs"))


@query("ml1_vocabulary", "with w as (select unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) as token from documents), c as (select token, count(*)::bigint as n from w group by 1), k as (select *, row_number() over (order by n desc) as r, (select min(n) from (select n from c order by n desc limit 5001)) as least from c) select token, n from k where n > least")
def bag_vocabulary(spark, d):
    """ML1, ML2: the tokens of the bag of words with their counts in the corpus, but for those whose count is that of the first one left out."""
    rows = documents(spark, d).select(tokens.words(F.col("text")).alias("tokens"))
    model = learning.bag_of_words()[0].fit(rows)
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(t,) for t in model.vocabulary], "token string")  # the vocabulary's size at most
    least = counts.orderBy(F.desc("n")).limit(5001).agg(F.min("n").alias("least"))
    return counts.join(known, "token").join(F.broadcast(least)).where("n > least").select("token", "n")  # one row


@query("ml1_sequence_tokens", "select doc_id, array_to_string(list_filter([(doc_id % 7)::varchar, (doc_id % 13)::varchar, (doc_id * 3)::varchar], lambda t: length(t) >= 2), ' ') as tokens from documents")
def sequence_tokens(spark, d):
    seq = F.array((F.col("doc_id") % 7).cast("int"), (F.col("doc_id") % 13).cast("int"), (F.col("doc_id") * 3).cast("int"))
    return learning.as_tokens(documents(spark, d).select("doc_id", seq.alias("seq"))).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("agg12_size_limit", "select conv_id as base, count(*)::bigint as parts, sum(octet_length(encode(coalesce(text, ''))))::bigint as bytes from conversations group by 1")
def combined_sizes(spark, d):
    t = table(spark, d, "conversations")
    parts = t.select(F.lit("js").alias("kind"), F.col("conv_id").alias("base"), F.col("turn").alias("part"), F.coalesce("text", F.lit("")).alias("content"))
    whole = pairing.combined(parts).select("base", "parts", (F.octet_length("content") - F.col("parts") + 1).cast("long").alias("bytes"))
    return whole
