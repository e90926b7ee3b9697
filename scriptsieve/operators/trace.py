"""Features and labels of API-call traces.

A trace is rows (script, seq, symbol, argument, value); seq orders the calls of a script."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number, strip, symbol

#: The symbols that have features or signal a behaviour.
CONTEXT = "canvasrenderingcontext2d"
COOKIE = "window.document.cookie"
STYLES = [f"{CONTEXT}.strokestyle", f"{CONTEXT}.fillstyle", f"{CONTEXT}.shadowcolor"]
FILTER = f"{CONTEXT}.filter"
AREAS = [
    *(f"{CONTEXT}.{x}" for x in ("fillrect", "rect", "getimagedata", "strokerect", "clearrect")),
    "webgl2renderingcontext.viewport", "webglrenderingcontext.viewport", "webglrenderingcontext.scissor", "webgl2renderingcontext.readpixels", "webglrenderingcontext.readpixels",
]
ARC = f"{CONTEXT}.arc"
FIRST_ARGUMENT = ["htmlcanvaselement.getelementsbytagname", "document.getelementsbytagname", "audiocontext.createchannelmerger"]
ITEMS = {
    "document.getelementsbytagname": ["head", "body", "div", "script", "ins", "iframe", "a", "span", "canvas"],
    f"{CONTEXT}.strokestyle": ["gradient", "color"],
    f"{CONTEXT}.fillstyle": ["gradient", "color"],
}
LIMIT = 5


@dataclass(frozen=True)
class Signals:
    """For each signal, substrings and exact symbols; a call gives the first signal that it meets."""

    contains: Mapping[str, Sequence[str]] = field(default_factory=dict)
    equals: Mapping[str, Sequence[str]] = field(default_factory=dict)
    order: Sequence[str] = ()

    def column(self, sym: Column) -> Column:
        out = F
        for name in self.order:
            tests = [sym.contains(x) for x in self.contains.get(name, ())]
            if self.equals.get(name):
                tests.append(sym.isin(*self.equals[name]))
            test = tests[0]
            for t in tests[1:]:
                test = test | t
            out = out.when(test, F.lit(name))
        return out


#: Which symbols are which signal, in the order in which they are tried.
TRACE_SIGNALS = Signals(
    contains={
        "text": [f"{CONTEXT}.filltext", f"{CONTEXT}.stroketext"], "style": [f"{CONTEXT}.fillstyle", f"{CONTEXT}.strokestyle"], "data": ["htmlcanvaselement.todataurl"],
        "font": [f"{CONTEXT}.font"], "measure": [f"{CONTEXT}.measuretext"],
    },
    equals={
        "state": [f"{CONTEXT}.save", f"{CONTEXT}.restore", f"{CONTEXT}.addeventlistener"],
        "channel": ["rtcpeerconnection.createdatachannel", "rtcpeerconnection.createoffer"], "candidate": ["rtcpeerconnection.onicecandidate", "rtcpeerconnection.localdescription"],
        "audio": [f"offlineaudiocontext.{x}" for x in ("createoscillator", "createdynamicscompressor", "destination", "startrendering", "oncomplete")],
    },
    order=["text", "style", "data", "state", "channel", "candidate", "font", "measure", "audio"],
)


def normalised(calls: DataFrame) -> DataFrame:
    """Calls with a symbol, lower-cased and stripped."""
    return calls.where("symbol is not null").withColumn("symbol", symbol(F.col("symbol")))


def without_repeats(calls: DataFrame, keys: Sequence[str] = ("symbol", "value")) -> DataFrame:
    """Calls that differ in `keys` from the call before them in their script; nulls equal each other."""
    before = F.lag(F.struct(*keys)).over(Window.partitionBy("script").orderBy("seq"))
    return calls.withColumn("__before", before).where(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(F.struct(*keys))).drop("__before")


def onegrams(calls: DataFrame) -> DataFrame:
    return normalised(calls).groupBy("script", "symbol").agg(F.count("*").alias("n"))


def onegram_maps(calls: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("symbol", "n")))
    return onegrams(calls).groupBy("script").agg(F.map_from_entries(pairs).alias("onegrams"))


def first_values(features: DataFrame, limit: int = LIMIT) -> DataFrame:
    """script, name, values: the first values of each feature in the order of calls; a group limit keeps what is shuffled small."""
    rank = F.row_number().over(Window.partitionBy("script", "name").orderBy("seq"))
    kept = features.withColumn("__rank", rank).where(F.col("__rank") <= limit)
    return kept.groupBy("script", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("values"))


def _given(c: Column) -> Column:
    return c.isNotNull() & (c != "null") & (strip(c) != "")


def value_features(calls: DataFrame, limit: int = LIMIT, keep_empty: bool = False) -> DataFrame:
    """script, name, values of the features that calls' values give. keep_empty: symbols with values but no feature have an empty list."""
    given = normalised(calls).where(_given(F.col("value")))
    sym, v = F.col("symbol"), F.col("value")
    feature = (
        F.when(sym == COOKIE, F.size(F.split(v, ";")).cast("string"))
        .when(sym.isin(*STYLES), F.when(v.contains("("), "gradient").otherwise("color"))
        .when(sym == FILTER, F.when(v.contains("("), v).otherwise(""))
    )
    out = first_values(given.select("script", "seq", sym.alias("name"), feature.alias("value")).where("value is not null"), limit)
    if not keep_empty:
        return out
    names = given.select("script", sym.alias("name")).distinct()
    return names.join(out, ["script", "name"], "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def arguments(argument: Column) -> Column:
    """A call's arguments by position or name, from a JSON array or object; null for what is neither."""
    listed = F.from_json(argument, "array<string>")
    named = F.from_json(argument, "map<string,string>")
    by_place = F.map_from_entries(F.transform(listed, lambda x, i: F.struct(i.cast("string"), x)))
    start = F.ltrim(argument)
    return F.when(~_given(argument), None).when(start.startswith("["), by_place).when(start.startswith("{"), named)


def argument_features(calls: DataFrame, areas: Sequence[str] = tuple(AREAS), arcs: Sequence[str] = (ARC,), firsts: Sequence[str] = tuple(FIRST_ARGUMENT), limit: int = LIMIT) -> DataFrame:
    """script, name, values: whether areas and arcs start on the screen, their sizes, and first arguments."""
    given = normalised(calls).withColumn("__args", arguments(F.col("argument"))).where("__args is not null")
    arg = lambda k: number(F.try_element_at("__args", F.lit(k)))
    x, y, w, h = map(arg, "0123")
    text = lambda c: c.cast("double").cast("string")
    on_screen = F.coalesce((x >= 0) & (y >= 0), F.lit(False)).cast("int").cast("string")
    area = F.coalesce(w * h, F.lit(0.0))
    circle = F.coalesce(F.pi() * F.pow(w, 2), F.lit(0.0))
    sym = F.col("symbol")
    feature = lambda suffix, value: F.struct(F.concat(sym, F.lit(suffix)).alias("name"), value.alias("value"))
    found = (
        F.when(sym.isin(*areas), F.array(feature("-OnScreen", on_screen), feature("-Size", text(area))))
        .when(sym.isin(*arcs), F.array(feature("-OnScreen", on_screen), feature("-Size", text(circle))))
        .when(sym.isin(*firsts) & F.map_contains_key("__args", F.lit("0")), F.array(feature("", F.try_element_at("__args", F.lit("0")))))
    )
    rows = given.select("script", "seq", F.explode(found).alias("f")).select("script", "seq", "f.name", "f.value")
    return first_values(rows, limit)


def one_hot(features: DataFrame, items: Mapping[str, Sequence[str]] = ITEMS) -> DataFrame:
    """script, name, vectors: for listed features a unit vector for each value, zeros for unknown ones; other features are left out."""
    known = F.create_map(*[x for k, v in items.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = features.withColumn("__items", F.try_element_at(known, F.col("name"))).where("__items is not null")
    return out.select("script", "name", F.transform("values", lambda v: F.transform(F.col("__items"), lambda i: F.coalesce((i == v).cast("int"), F.lit(0)))).alias("vectors"))


def combined_features(values: DataFrame, args: DataFrame) -> DataFrame:
    """Both kinds of features; of two with one name in a script that of the arguments stays."""
    return args.unionByName(values.join(args.select("script", "name"), ["script", "name"], "left_anti"))


def ground_truth(calls: DataFrame, signals: Signals = TRACE_SIGNALS, more_than: int = 20) -> DataFrame:
    """script and five labels, from which signals its calls give. A null value of a font call counts as one value."""
    sig = signals.column(F.col("symbol"))
    has = lambda name: F.coalesce(F.bool_or(F.col("signal") == name), F.lit(False))
    font = F.col("signal") == "font"
    fonts = F.count_distinct(F.when(font, F.col("value"))) + F.coalesce(F.max(F.when(font & F.col("value").isNull(), 1)), F.lit(0))
    labelled = normalised(calls).withColumn("signal", sig).groupBy("script").agg(
        (has("text") & has("style") & has("data") & ~has("state")).alias("is_canvas"),
        (has("channel") & has("candidate")).alias("is_webrtc"),
        ((fonts > more_than) & (F.count_if(F.col("signal") == "measure") > more_than)).alias("is_canvasfont"),
        has("audio").alias("is_audio"),
    )
    return labelled.withColumn("is_fingerprinting", F.expr("is_canvas or is_webrtc or is_canvasfont or is_audio"))


def setter_calls(calls: DataFrame) -> DataFrame:
    """Calls that hooks log for writes: no value and a list of one argument."""
    return calls.where(F.col("value").isNull() & (F.json_array_length("argument") == 1))


def hook_kind(argument: Column, value: Column) -> Column:
    """What kind of hook logged a call: a setter has no value and one argument, a getter an empty object for arguments, a method a list."""
    setter = value.isNull() & F.coalesce(F.json_array_length(argument) == 1, F.lit(False))
    return F.when(setter, "setter").when(F.regexp_replace(argument, r"\\s", "") == "{}", "getter").when(F.ltrim(argument).startswith("["), "method")


def coverage(calls: DataFrame, surface: DataFrame) -> DataFrame:
    """symbol, n: how often each symbol of a hooked surface was called, 0 for those that never were."""
    counts = normalised(calls).groupBy("symbol").agg(F.count("*").alias("n"))
    names = surface.select(F.lower("symbol").alias("symbol")).distinct()
    return names.join(counts, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))


#: How a catalogue's families treat a call.
FAMILIES = ("value_numeric", "value_categorical", "value_length", "value_json_length", "arguments_categorical", "arguments_length", "argument_json_length")


def catalogued(calls: DataFrame, catalogue: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Features that a catalogue (name, family) asks for, first values of each; families with rules of their own are `value_features` and `argument_features`."""
    names = catalogue.where(F.col("family").isin(*FAMILIES)).select(F.lower("name").alias("symbol"), "family").distinct()
    c = normalised(calls).join(names, "symbol")
    first = F.try_element_at(arguments(F.col("argument")), F.lit("0"))
    size = lambda x: F.coalesce(F.json_array_length(x), F.size(F.json_object_keys(x)))
    value = (
        F.when(F.col("family") == "value_numeric", number(F.col("value")).cast("string"))
        .when(F.col("family") == "value_categorical", F.col("value"))
        .when(F.col("family") == "value_length", F.length("value").cast("string"))
        .when(F.col("family") == "value_json_length", size(F.col("value")).cast("string"))
        .when(F.col("family") == "arguments_categorical", first)
        .when(F.col("family") == "arguments_length", F.length("argument").cast("string"))
        .otherwise(size(F.col("argument")).cast("string"))
    )
    rows = c.select("script", "seq", F.concat_ws("/", "family", "symbol").alias("name"), value.alias("value")).where("value is not null")
    return first_values(rows, limit)
