"""Mixing of sources to target weights, in DataFrame operations only.

Method: iterative proportional fitting. Tokens are summed by cell (source, language, topic); cell weights start at these
sums and are raked in turn to the target share of each source, language and topic, until the rounds are done. A cell's ratio of
weight to tokens, times a factor that all cells share, is how often its documents are expected in a sample, so that the
expected tokens of a sample have the raked shares: the whole part of it is certain, and the rest is drawn by a hash of the id.
The factor is the target size of the sample in tokens over the tokens there are, 1 where no size is given; rows of
under-represented cells repeat, so that a small cell takes nothing from the others. `op4_mixing` has no copies, as in its SQL:
there the factor is 1 over the largest ratio, and the most under-represented cell sets the size of the sample.

Only sums by cell are shuffled, with map-side partials, so that a source with a third of all rows is a row a task. Up to ONE_TASK cells, which are
counted first, are raked in one task, where windows by margin need no exchange; more are raked by the same windows over all tasks. Rounds go on in
blocks until the margins are within TOLERANCE of their targets, or can't come closer.
Null margins are the value "(none)". Null and empty texts have no tokens: they don't count in any cell and are kept with
probability 1. A margin value without a target, or with a target of 0, has probability 0. Rows that repeat are drawn alike; a null id
is drawn as the text "null". The order of rows doesn't matter. Other columns are kept by `sample`.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, unused

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
#: Target shares follow the tokens to this power where none are given: below 1 lifts rare values.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Rounds of a block, blocks at most, largest difference of a margin from its target as a share of all tokens, cells that one task rakes.
ROUNDS, BLOCKS, TOLERANCE, ONE_TASK = 8, 12, 1e-6, 1 << 20
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"
LEGAL, RECORDS = r"(?i)licen[sc]e|copyright|warrant", r"@|[0-9]{4}"


def topic(text: Column) -> Column:
    """A coarse topic of a text: legal lines, records with addresses or long numbers, short notes, prose."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(LEGAL), "legal").when(text.rlike(RECORDS), "records").when(F.length(text) < 600, "note").otherwise("prose")


def weighed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: Column | None = None) -> DataFrame:
    """id, source, lang, topic, tokens of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.lit(NONE)
    about = topic(F.col(text_col)) if topic_col is None else F.coalesce(topic_col, none)
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), none).alias("source"), F.coalesce(F.col(lang_col), none).alias("lang"), about.alias("topic"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"))


def raked(cells: DataFrame, targets: Mapping[str, DataFrame] | None = None, rounds: int = ROUNDS, blocks: int = BLOCKS) -> DataFrame:
    """cells: source, lang, topic, tokens (one row each, tokens > 0). Returns them with `weight`, raked to the targets: for each margin rows (value, share)."""
    n, total = cells.agg(F.count("*"), F.sum("tokens")).first()
    at = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        if targets and m in targets:
            share = targets[m].select(F.col("value").alias(m), F.col("share").cast("double").alias("share"))
        else:
            share = cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(FLATTEN[m])).alias("share"))
        whole = share.agg(F.sum("share")).first()[0] or 1.0
        at = at.join(share.select(m, (F.col("share") / F.lit(whole) * F.lit(float(total or 0))).alias(f"want_{m}")), m, "left").fillna(0.0, [f"want_{m}"])
    at, off = cut(at), float("inf")
    for _ in range(blocks):
        at = at.coalesce(1) if n <= ONE_TASK else at
        for _ in range(rounds):
            for m in MARGINS:
                at = at.withColumn("have", F.sum("weight").over(Window.partitionBy(m)))
                at = at.withColumn("weight", F.when(F.col("have") > 0, F.col("weight") * F.col(f"want_{m}") / F.col("have")).otherwise(F.lit(0.0))).drop("have")
        at = cut(at)
        if blocks == 1:
            break
        before, off = off, _residual(at, total)
        if off <= TOLERANCE or off > 0.9 * before:
            break
    return at.select(*MARGINS, "tokens", "weight")


def _residual(at: DataFrame, total: int | None) -> float:
    """The largest difference of a margin's weight from its target, as a share of all tokens, among margins that some cell can meet; 0 without cells."""
    found = [at.groupBy(m).agg(F.abs(F.sum("weight") - F.first(f"want_{m}")).alias("off")).agg(F.max("off").alias("off")) for m in MARGINS]
    off = reduce(DataFrame.unionByName, found).agg(F.max("off")).first()[0]
    return off / total if total else 0.0


def drawn(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) by the hash of an id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def calibrated(df: DataFrame, targets: Mapping[str, DataFrame] | None = None, rounds: int = ROUNDS, seed: str = SEED, budget: int | None = None, once: bool = False, blocks: int = BLOCKS, **columns) -> DataFrame:
    """id, source, lang, topic, tokens, probability, sampled, copies for each row of df. budget: tokens of the sample; once: no row more than once, whatever size that leaves."""
    rows = cut(weighed(df, **columns))
    cells = raked(rows.where("tokens > 0").groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), targets, rounds, blocks)
    ratio = cells.select(*MARGINS, (F.col("weight") / F.col("tokens")).alias("ratio"))
    if once:
        unit = ratio.agg(F.max("ratio")).first()[0] or 1.0
    else:
        unit = 1.0 if not budget else (cells.agg(F.sum("tokens")).first()[0] or 1) / budget
    odds = ratio.select(*MARGINS, F.round(F.col("ratio") / F.lit(unit), 9).alias("odds"))
    found = rows.join(odds, list(MARGINS), "left").withColumn("odds", F.when(F.col("tokens") > 0, F.coalesce("odds", F.lit(0.0))).otherwise(F.lit(1.0)))
    whole = F.floor("odds")
    copies = (whole + (drawn(F.col("id"), seed) < F.col("odds") - whole).cast("long")).alias("copies")
    return found.select("id", *MARGINS, "tokens", F.least("odds", F.lit(1.0)).alias("probability"), copies).select("id", *MARGINS, "tokens", "probability", (F.col("copies") > 0).alias("sampled"), "copies")


def sample(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The sampled rows of df, with its columns, each as often as it was drawn."""
    key, copies, copy = unused(df, "sampled"), unused(df, "copies"), unused(df, "copy")
    names = calibrated(df, id_col=id_col, **options).where("sampled").groupBy(F.col("id").alias(key)).agg(F.max("copies").alias(copies))
    found = df.join(names, df[id_col].eqNullSafe(names[key]))
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*(df[c] for c in df.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calibrated(table(spark, sf_dir, "documents"), once=True, blocks=1)  # ROUNDS rounds, as its SQL
    return found.select(F.col("id").alias("doc_id"), *MARGINS, F.col("tokens").alias("n_tokens"), "probability", "sampled")


def _oracle() -> str:
    topics = f"case when regexp_matches(t, '{LEGAL}') then 'legal' when regexp_matches(t, '{RECORDS}') then 'records' when length(t) < 600 then 'note' else 'prose' end"
    steps = [
        "d as (select doc_id, source, lang, coalesce(text, '') as t from documents)",
        f"r as (select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang, {topics} as topic, len(regexp_extract_all(t, '{WORD}'))::bigint as tokens from d)",
        "c as (select source, lang, topic, sum(tokens)::bigint as tokens from r where tokens > 0 group by all)",
    ]
    for m in MARGINS:
        steps.append(f"p_{m} as (select {m}, pow(sum(tokens)::double, {FLATTEN[m]}) as share from c group by {m})")
        steps.append(f"w_{m} as (select {m}, share / (select sum(share) from p_{m}) * (select sum(tokens) from c)::double as want from p_{m})")
    before = "(select *, tokens::double as weight from c)"
    for k in range(ROUNDS):
        for m in MARGINS:
            steps.append(f"x_{k}_{m} as materialized (select b.* exclude (weight), b.weight * w.want / sum(b.weight) over (partition by b.{m}) as weight from {before} b join w_{m} w using ({m}))")
            before = f"x_{k}_{m}"
    steps.append(f"o as (select source, lang, topic, round(weight / tokens / (select max(weight / tokens) from {before}), 9) as odds from {before})")
    steps.append("f as (select r.*, case when tokens > 0 then coalesce(odds, 0.0) else 1.0 end::double as probability from r left join o using (source, lang, topic))")
    drawn_sql = f"('0x' || substr(md5('{SEED}:' || doc_id::varchar), 1, 12))::bigint::double / {16**12}.0"
    return f"with {', '.join(steps)} select doc_id, source, lang, topic, tokens as n_tokens, probability, {drawn_sql} < probability as sampled from f"


ORACLE = _oracle()
