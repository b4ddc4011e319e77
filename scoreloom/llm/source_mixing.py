"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

Equal-token blocks are the seats. The sources get their seats by highest quotients v / (2k + 1) on their target
words; each source's seats go on to its shards in the same way, by the shards' words. In each shard, whole rounds over all its blocks come first and the rest
are consecutive blocks from a seeded start on. A document takes what the chosen blocks cover of it.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own, last in order; an empty
table gives no rows; repeated rows each take part as rows of their own (they share a doc_id, and so a place in
the seeded order, told apart by a number); columns beyond doc_id, text and source pass through ``mix`` under any name. A very long text lies in one shard,
which is longer by it. Equal quotients go to the smaller source, batch or shard. The table of sources is ordered in one task: one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, Scratch, documents

WEIGHTS = (1, 2, 3)
CEILING = 3
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 15
#: Shards that are ranked together.
BATCH = 4096
SEED = "mix-1"


def _number(*parts: Column) -> Column:
    """A seeded 60-bit number of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def _targets(sizes: DataFrame) -> DataFrame:
    """By source: weight and target, min(3 * size, level * weight), with the level at which all targets sum to all sizes.

    With the sources ordered by the level at which they reach their ceiling, a prefix is full and the rest share by weight.
    """
    order = W.orderBy(F.col("src").isNull(), F.col("src"))
    by_ratio = W.orderBy("ratio", F.col("src").isNull(), "src")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(W.partitionBy())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    t = sizes.withColumns({"weight": weight, "total": total}).withColumn("full", CEILING * F.col("source_size").cast("double"))
    t = t.withColumn("ratio", F.col("full") / F.col("weight"))
    t = t.withColumns({
        "full_before": F.coalesce(F.sum("full").over(before), F.lit(0.0)),
        "weight_left": F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    # the level is that of the first source that does not reach its ceiling
    t = t.withColumn("at", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(W.partitionBy())["level"])
    return t.withColumn("target", F.least("full", F.coalesce(F.col("at") * F.col("weight"), F.col("full"))))


def _seats(votes: DataFrame, group: list[str], key: list[str], vote: str, seats: str) -> DataFrame:
    """Sainte-Laguë: ``won`` for each row of ``votes``, by group, of the group's ``seats``.

    A row's seats differ from its exact share by less than twice its share of the rows' number, plus 2; only quotients in
    that span are laid out and ranked, a few for each row.
    """
    w = W.partitionBy(*group) if group else W.partitionBy()
    t = votes.withColumns({"_all": F.sum(vote).over(w), "_n": F.count(F.lit(1)).over(w)})
    part = F.col(vote) / F.col("_all")
    span = F.ceil(2 * F.col("_n") * part) + 2
    share = F.floor(F.coalesce(F.col(seats) * part, F.lit(0.0)))
    t = t.withColumn("_from", F.greatest(F.lit(0), share - F.coalesce(span, F.lit(0))).cast("long"))
    t = t.withColumn("_to", F.when(F.col(vote) > 0, share + span).otherwise(F.lit(-1)).cast("long"))
    t = t.withColumn("_open", F.col(seats) - F.sum("_from").over(w))
    rank = F.row_number().over(w.orderBy(F.desc("_quotient"), *[x for k in key for x in (F.col(k).isNull(), F.col(k))], "_k"))
    laid = t.where("_to >= _from").withColumn("_k", F.explode(F.sequence("_from", "_to"))).withColumn("_quotient", F.col(vote) / (2 * F.col("_k") + 1))
    won = laid.withColumn("_rank", rank).groupBy(*[c for c in votes.columns], "_from").agg(F.sum((F.col("_rank") <= F.col("_open")).cast("long")).alias("_more"))
    return won.withColumn("won", F.col("_from") + F.col("_more")).drop("_from", "_more")


def _number_of_row(source: Column, text: Column) -> Column:
    """Rows of one doc_id are told apart by what they hold, which a rerun finds again; ``plan`` numbers those that hold the same."""
    return F.md5(F.concat(F.coalesce(source, F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))


def plan(docs: DataFrame, spark: SparkSession, scratch: Scratch) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, source): row, n, doc_id, size, source_size, target, rounds and spans (from, to: words of it, to excluded).

    Documents of a source are dealt to shards of about SHARD_WORDS words and put in a seeded order there. A shard's blocks are runs of BLOCK_WORDS words
    in this order; the blocks beyond its whole rounds are consecutive ones from a seeded start on, so that at most three documents of a shard are cut.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    again = F.row_number().over(W.partitionBy("doc_id", "row").orderBy("size"))
    sized = docs.select(_number_of_row(F.col("source"), F.col("text")).alias("row"), "doc_id", F.col("source").alias("src"), words.alias("size"))
    sized = scratch.table(sized.withColumn("n", again), "sized")
    by_source = _targets(sized.groupBy("src").agg(F.sum("size").alias("source_size")))
    by_source = by_source.withColumn("seats", F.round(F.col("total") / BLOCK_WORDS).cast("long")).withColumn("seats", F.greatest("seats", F.lit(1).cast("long")))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long").alias("shards")
    by_source = by_source.select("src", "source_size", "target", "seats", shards)
    won = _seats(by_source, [], ["src"], "target", "seats").select("src", F.col("won").alias("quota"))
    by_source = scratch.table(by_source.drop("seats").join(won, by_source.src.eqNullSafe(won.src), "left").drop(won.src).fillna(0, ["quota"]), "sources")

    # the table of sources is one row a source, which the ordering of sources above bounds
    placed = sized.join(by_source, sized.src.eqNullSafe(by_source.src)).drop(by_source.src)
    placed = placed.withColumn("shard", F.pmod(_number(F.lit("shard"), F.col("doc_id"), F.col("row")), F.col("shards")))
    run = W.partitionBy("src", "shard").orderBy(_number(F.lit("place"), F.col("doc_id")), "doc_id", "row", "n")
    placed = placed.withColumn("end", F.sum("size").over(run)).withColumn("begin", F.col("end") - F.col("size"))
    placed = scratch.table(placed.select("row", "n", "doc_id", "size", "source_size", "target", "src", "shard", "begin", "end"), "placed")
    taken = scratch.table(_chosen(placed, by_source), "shards")
    same = F.col("src").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h"))
    out = placed.join(taken.hint("merge"), same, "left").fillna(0, ["rounds"])
    inside = lambda a, z: F.struct(F.greatest(a - F.col("begin"), F.lit(0)).cast("long").alias("from"), F.least(z - F.col("begin"), F.col("size")).cast("long").alias("to"))
    spans = F.filter(F.array(inside(F.lit(0).cast("long"), F.col("b1")), inside(F.col("a0"), F.col("a1"))), lambda x: x["to"] > x["from"])
    spans = F.when(F.col("a0").isNull(), F.filter(F.array(inside(F.col("begin"), F.col("begin"))), lambda x: F.lit(False))).otherwise(spans)
    return out.select("row", "n", "doc_id", "size", "source_size", "target", "rounds", spans.alias("spans"))


def _chosen(placed: DataFrame, by_source: DataFrame) -> DataFrame:
    """By shard (s, h): rounds, and the words of its chosen blocks, [a0, a1) and [0, b1).

    A source's seats go to batches of BATCH shards first and then to the shards of each, so that no source is ranked in one task whole.
    """
    shards = placed.groupBy("src", "shard").agg(F.sum("size").alias("words")).where("words > 0").withColumn("batch", F.floor(F.col("shard") / BATCH).cast("long"))
    quotas = by_source.select(F.col("src").alias("s"), F.col("quota"))
    batches = shards.groupBy("src", "batch").agg(F.sum("words").alias("in_batch")).join(quotas, F.col("src").eqNullSafe(F.col("s"))).drop("s")
    batches = _seats(batches, ["src"], ["batch"], "in_batch", "quota").select(F.col("src").alias("s"), F.col("batch").alias("b"), F.col("won").alias("seats"))
    shards = shards.join(batches, F.col("src").eqNullSafe(F.col("s")) & (F.col("batch") == F.col("b"))).drop("s", "b")
    shards = _seats(shards, ["src", "batch"], ["shard"], "words", "seats").withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / BLOCK_WORDS)).cast("long"))
    shards = shards.withColumn("won", F.least("won", CEILING * F.col("blocks")))
    shards = shards.withColumn("rounds", F.floor(F.col("won") / F.col("blocks"))).withColumn("rest", F.col("won") - F.col("rounds") * F.col("blocks"))
    start = F.pmod(_number(F.lit("block"), F.col("shard"), F.coalesce("src", F.lit(""))), F.col("blocks"))
    # block k of a shard is words [floor(k * words / blocks), floor((k + 1) * words / blocks))
    bound = lambda k: F.floor(k * F.col("words") / F.col("blocks"))
    stop = F.col("start") + F.col("rest")
    return shards.withColumn("start", start).select(
        F.col("src").alias("s"), F.col("shard").alias("h"), "rounds", bound(F.col("start")).alias("a0"), bound(F.least(stop, F.col("blocks"))).alias("a1"),
        bound(F.greatest(stop - F.col("blocks"), F.lit(0))).alias("b1"))


def mix(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """The mixed corpus: for each document as many whole copies as its shard has whole rounds, and one row of the words that chosen blocks cover.

    The result has the columns of ``docs``, whatever their names; n_chars, where there, is set anew. Of rows with the same doc_id, text and source
    one lends its further columns to what all of them take.
    """
    takes = plan(docs.select("doc_id", "text", "source"), spark, scratch := Scratch(spark, "mix"))
    takes = scratch.table(takes.where("(rounds > 0 or size(spans) > 0) and size > 0").select("row", "doc_id", "rounds", "size", "spans"), "takes")
    mark = _number_of_row(F.col("source"), F.col("text"))
    own = docs.select(mark.alias("mark"), F.col("doc_id").alias("doc"), F.struct(*docs.columns).alias("whole")).groupBy("mark", "doc").agg(F.any_value("whole").alias("whole"))
    both = own.join(takes.hint("merge"), (F.col("mark") == F.col("row")) & F.col("doc").eqNullSafe(F.col("doc_id")))
    words = F.regexp_extract_all(F.col("whole.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    # within an array of one the text is cut into words once, not once a span
    cut = lambda ws: F.flatten(F.transform("spans", lambda s: F.slice(ws, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))))
    part = F.array_join(F.transform(F.array(words), cut)[0], "")
    covered = F.element_at("spans", 1)
    part = F.when((F.size("spans") == 1) & (covered["from"] == 0) & (covered["to"] == F.col("size")), F.col("whole.text")).otherwise(part)
    texts = F.concat(F.array_repeat(F.col("whole.text"), F.col("rounds").cast("int")), F.when(F.size("spans") == 0, F.array().cast("array<string>")).otherwise(F.array(part)))
    out = both.select("whole", F.explode(texts).alias("text"))
    made = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[made.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``documents``."""
    out = plan(documents(spark, sf_dir).select("doc_id", "text", "source"), spark, Scratch(spark, "op9"))
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("rounds") * F.col("size") + extra).cast("long").alias("taken"))


def _sql_number(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{SEED}', {', '.join(parts)})), 1, 15))::bigint"


SQL = f"""
with d as (select doc_id, source as src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, md5(coalesce(source, '') || '|' || coalesce(text, '')) as r from documents),
e as (select *, row_number() over (partition by doc_id, r order by size) as n from d),
s as (select src, sum(size)::bigint as ss, row_number() over (order by src is null, src) as o from d group by src),
t as (select *, [1.0, 2.0, 3.0][(o - 1) % 3 + 1]::double as w, sum(ss) over ()::bigint as total, {CEILING} * ss::double as f from s),
u as (select *, f / w as ratio, coalesce(sum(f) over b, 0) as fb, sum(w) over () - coalesce(sum(w) over b, 0) as wl from t
      window b as (order by f / w, src is null, src rows between unbounded preceding and 1 preceding)),
v as (select *, (total - fb) / wl as lvl from u),
g as (select src, ss, least(f, coalesce((select lvl from v where lvl <= ratio order by ratio, lvl limit 1) * w, f)) as target,
      greatest(1, round(total / {BLOCK_WORDS}))::bigint as seats, greatest(1, ceil(ss / {SHARD_WORDS}))::bigint as shards from v),
q as (select src, seats, row_number() over (order by target / (2 * k + 1) desc, src is null, src, k) as rk from (select *, unnest(range(0, 3 * ss // {BLOCK_WORDS} + 40)) as k from g where target > 0)),
quotas as (select src, count(*) as quota from q where rk <= seats group by src),
p as (select e.*, g.ss, g.target, {_sql_number("'shard'", "e.doc_id", "e.r")} % g.shards as shard from e join g on e.src is not distinct from g.src),
z as (select *, sum(size) over (partition by src, shard order by {_sql_number("'place'", "doc_id")}, doc_id, r, n rows unbounded preceding)::bigint as stop from p),
h as (select src, shard, shard // {BATCH} as batch, sum(size)::bigint as words from p group by src, shard having sum(size) > 0),
hb as (select h.src, batch, sum(words)::bigint as words, coalesce(any_value(quota), 0) as quota from h left join quotas on h.src is not distinct from quotas.src group by h.src, batch),
bq as (select src, batch, quota, row_number() over (partition by src order by words / (2 * k + 1) desc, batch, k) as rk from (select *, unnest(range(0, 3 * words // {BLOCK_WORDS} + 40)) as k from hb)),
bw as (select src, batch, count(*) as seats from bq where rk <= quota group by src, batch),
hq as (select h.src, shard, seats, row_number() over (partition by h.src, h.batch order by words / (2 * k + 1) desc, shard, k) as rk
       from (select *, unnest(range(0, 3 * words // {BLOCK_WORDS} + 40)) as k from h) h join bw on h.src is not distinct from bw.src and h.batch = bw.batch),
hw as (select src, shard, count(*) as won from hq where rk <= seats group by src, shard),
b as (select h.src, h.shard, words, greatest(1, round(words / {BLOCK_WORDS}))::bigint as blocks, coalesce(won, 0) as won from h left join hw on h.src is not distinct from hw.src and h.shard = hw.shard),
c as (select *, least(won, {CEILING} * blocks) // blocks as rounds, least(won, {CEILING} * blocks) % blocks as rest, {_sql_number("'block'", "shard", "coalesce(src, '')")} % blocks as start from b),
i as (select *, start * words // blocks as a0, least(start + rest, blocks) * words // blocks as a1, greatest(start + rest - blocks, 0) * words // blocks as b1 from c)
select z.doc_id, size, ss as source_size, target,
       (coalesce(rounds, 0) * size + coalesce(greatest(0, least(a1, stop) - greatest(a0, stop - size)) + greatest(0, least(b1, stop) - (stop - size)), 0))::bigint as taken
from z left join i on z.src is not distinct from i.src and z.shard = i.shard
"""
