"""Queries of the engine's own operators over the driver's tables, each with the SQL it is held against.

The driver's tables are not documents with ground truth, so each operator runs on the nearest column: the operator is what
is tested. Every query reads its whole tables. ``sql=None`` marks what SQL cannot express; tests hold those against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry, kernels, numbers, text
from ..operators import aggregate, align, compare, confidence, evidence, gates, grounding, jsontree, layout, rules, scoring, table_rules, tables
from ..sources import adapters
from ..streaming import score_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (t -> DataFrame), where t(name) reads a table, under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- aggregation -----------------------------------------------------------------------------------------------------------


@query("""
with f as (select d.lang, case when d.n_chars > 1000 and l.quality = 1 then 1 else 0 end tp, case when d.n_chars > 1000 and l.quality = 0 then 1 else 0 end fp,
                  case when d.n_chars <= 1000 and l.quality = 1 then 1 else 0 end fn from documents d join labels l using (doc_id)),
     s as (select case when grouping(lang) = 1 then 'overall' else lang end as lang, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from f group by cube (lang))
select lang, tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as micro_precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as micro_recall,
       round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as micro_f1 from s""")
def prf_micro_macro_by_lang(t):
    long, good = F.col("n_chars") > 1000, F.col("quality") == 1
    facts = t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id")
    return aggregate.micro_by(facts.select("lang", (long & good).cast("int").alias("tp"), (long & ~good).cast("int").alias("fp"), (~long & good).cast("int").alias("fn")), "lang")


@query("""select o_orderpriority, count(*) n, sum((o_orderstatus = 'F')::int)::bigint n_failed, round(avg(case when o_orderstatus = 'F' then 0 else o_totalprice end), 6) avg_padded,
round(avg(case when o_orderstatus <> 'F' then o_totalprice end), 6) avg_success from orders group by 1""")
def metrics_with_failure_padding(t):
    return aggregate.padded_average(t("orders"), "o_orderpriority", "o_totalprice", F.col("o_orderstatus") != "F")


@query("""with s as (select event_type, list_sort(list(value)) v from events where value is not null group by 1)
select event_type, len(v)::bigint n, round(list_sum(v), 4) total, v[1] least, v[len(v)] most, v[1 + least(floor(len(v) * 0.5)::bigint, len(v) - 1)] p50, v[1 + least(len(v) * 90 // 100, len(v) - 1)] p90,
v[1 + least(len(v) * 95 // 100, len(v) - 1)] p95, v[1 + least(len(v) * 99 // 100, len(v) - 1)] p99 from s""")
def stats_percentiles_positional(t):
    return aggregate.positional(t("events"), ["event_type"], "value")


@query("select tag, count(*) n, round(avg(value), 6) average from (select unnest([event_type, 'user' || (user_id % 3)]) tag, value from events) group by 1")
def tag_explode_aggregate(t):
    tagged = t("events").withColumn("tags", F.array("event_type", F.concat(F.lit("user"), (F.col("user_id") % 3).cast("string"))))
    return aggregate.by_tag(tagged, "tags", "value")


@query("""select case grouping(l_returnflag, l_linestatus) when 3 then 'overall' when 1 then 'l_returnflag' else 'cell' end as level, coalesce(l_returnflag, '*') l_returnflag, coalesce(l_linestatus, '*') l_linestatus,
count(*) n, round(avg(l_quantity), 6) average from lineitem group by rollup (l_returnflag, l_linestatus)""")
def report_grouping_sets(t):
    return aggregate.report(t("lineitem"), "l_returnflag", "l_linestatus", "l_quantity")


@query("""select l_linenumber, round(sum(case when l_returnflag = 'A' then l_quantity end), 2) "l_returnflag_A", round(sum(case when l_returnflag = 'N' then l_quantity end), 2) "l_returnflag_N",
round(sum(case when l_returnflag = 'R' then l_quantity end), 2) "l_returnflag_R" from lineitem group by 1""")
def csv_pivot_metrics(t):
    return aggregate.pivoted(t("lineitem"), "l_linenumber", "l_returnflag", ["A", "N", "R"], "l_quantity")


@query("select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) r from lineitem) where r = 1")
def cost_dedupe_first(t):
    return aggregate.first_of(t("lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


# --- comparison ------------------------------------------------------------------------------------------------------------


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) where r = 1")
def latest_per_key(t):
    return compare.latest(t("events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("select user_id, count(distinct event_type) n_versions from events group by 1 having count(distinct event_type) > 1")
def mixed_version_guard(t):
    return compare.mixed_versions(t("events"), "user_id", "event_type")


@query("""with a as (select o_custkey k, avg(o_totalprice) s from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey k, avg(o_totalprice) s from orders where o_orderkey % 2 = 1 group by 1)
select k as o_custkey, round(a.s, 6) score_a, round(b.s, 6) score_b, case when b.s is null then 'only_a' when a.s is null then 'only_b' when a.s < 200000 and b.s < 200000 then 'both_bad'
when a.s > b.s then 'a_better' when a.s < b.s then 'b_better' else 'tie' end verdict from a full join b using (k)""")
def compare_pipelines_full_outer(t):
    half = lambda r: t("orders").where(F.col("o_orderkey") % 2 == r).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("score"))
    out = compare.compare(half(0), half(1), "o_custkey", 200000.0)
    return out.select("o_custkey", F.round("score_a", 6).alias("score_a"), F.round("score_b", 6).alias("score_b"), "verdict")


@query("""select n_nationkey, c_mktsegment, 0.0::double score from nation cross join (select distinct c_mktsegment from customer) s
where not exists (select 1 from customer c where c.c_nationkey = n_nationkey and c.c_mktsegment = s.c_mktsegment and c.c_acctbal > 8000)""")
def missing_attempts_anti(t):
    segments = t("customer").select("c_mktsegment").distinct()
    seen = t("customer").where("c_acctbal > 8000").withColumnRenamed("c_nationkey", "n_nationkey")
    return compare.missing_attempts(t("nation").select("n_nationkey"), segments, seen, ["n_nationkey", "c_mktsegment"])


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_custkey in (select c_custkey from customer where c_acctbal > 0) and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def failure_semi_anti(t):
    good = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    cases = t("orders").select("o_orderkey", "o_custkey").join(good, "o_custkey", "left_semi")
    errors = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    done = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return compare.failures(errors, cases, done, "o_orderkey")


@query("""with c as (select c_nationkey k, o_orderpriority p, avg(o_totalprice) v from orders join customer on o_custkey = c_custkey group by 1, 2),
s as (select k, count(*) n, round(sum(v), 4) rk, sum(v) t from c group by 1)
select k as c_nationkey, n as n_cells, rk as rank_key, case when n = 5 then round(t / 5, 4) end mean, rank() over (order by rk desc) as rank from s""")
def rank_matrix_conditional_mean(t):
    facts = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return compare.matrix(facts, "c_nationkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "o_totalprice")


@query("select user_id, event_type, count(*) votes from events group by 1, 2 having count(*) >= 2")
def consensus_vote(t):
    return compare.consensus(t("events"), ["user_id"], "event_type")


# --- confidence and order ------------------------------------------------------------------------------------------------------

SCORED = "s as (select d.doc_id, round(least(n_chars, 20000) / 20000, 3) c, l.quality q from documents d join labels l using (doc_id))"


def _scored(t):
    return t("documents").select("doc_id", F.round(F.least("n_chars", F.lit(20000)) / 20000, 3).alias("c")).join(t("labels").select("doc_id", F.col("quality").alias("q")), "doc_id")


@query(f"""with {SCORED}, r as (select q, rank() over (order by c) + (count(*) over (partition by c) - 1) / 2 as r from s),
a as (select sum(q) p, sum(1 - q) n, sum(case when q = 1 then r end) x from r)
select p::bigint n_positive, n::bigint n_negative, round((x - p * (p + 1) / 2) / (p * n), 6) auc from a""")
def roc_auc_tie_corrected(t):
    return confidence.roc_auc(_scored(t), "c", "q")


POINTS = f"{SCORED}, g as (select c, count(*) n, sum(q) k from s group by 1), p as (select c, sum(n) over w kept, sum(k) over w ok, sum(n) over () total from g window w as (order by c desc))"


@query(f"with {POINTS} select c as threshold, kept::bigint kept, ok::bigint as right, round(kept / total, 6) coverage, round(ok / kept, 6) as precision from p")
def coverage_precision_points(t):
    return confidence.thresholds(_scored(t), "c", "q").select("threshold", "kept", "right", F.round("coverage", 6).alias("coverage"), F.round("precision", 6).alias("precision"))


@query(f"with {POINTS}, z as (select kept / total as coverage, max(ok / kept) as precision from p group by 1 union all select 0, 1) select round(coverage, 6) coverage, round(precision, 6) as precision from z")
def coverage_precision_curve(t):
    return confidence.curve(confidence.thresholds(_scored(t), "c", "q")).select(F.round("coverage", 6).alias("coverage"), F.round("precision", 6).alias("precision"))


@query(f"""with {POINTS}, z as (select kept / total as x, max(ok / kept) as y from p group by 1 union all select 0, 1)
select round(sum(d * y), 6) as area from (select y, x - coalesce(lag(x) over (order by x), x) d from z)""")
def coverage_precision_auc(t):
    return confidence.area(confidence.curve(confidence.thresholds(_scored(t), "c", "q")))


@query(f"with {POINTS} select round(max(ok / kept), 6) as precision, count(*) n_thresholds from p where kept / total >= 0.5")
def precision_at_coverage(t):
    return confidence.best_at(confidence.thresholds(_scored(t), "c", "q"), 0.5)


@query("""with w as (select conv_id, turn, length(text) v from conversations), x as (select conv_id, v, max(v) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding) b,
min(v) over (partition by conv_id order by turn rows between 1 following and 3 following) a from w)
select conv_id, count(*) n, sum(((b is null or b < v) and (a is null or a > v))::int)::bigint n_ok from x group by 1""")
def reading_order_local(t):
    return confidence.local_order(t("conversations").withColumn("v", F.length("text")), "conv_id", "turn", "v")


@query("""with x as (select conv_id, length(text) v, lead(length(text)) over (partition by conv_id order by turn) z from conversations)
select conv_id, count(z) n_pairs, coalesce(sum((v <= z)::int), 0)::bigint n_ok from x group by 1""")
def reading_order_pairwise(t):
    return confidence.adjacent_order(t("conversations").withColumn("v", F.length("text")), "conv_id", "turn", "v")


@query("""with d as (select distinct o_custkey g, o_orderkey // 40 i from orders), r as (select g, i - row_number() over (partition by g order by i) k from d)
select g as o_custkey, max(n) longest from (select g, k, count(*) n from r group by 1, 2) group by 1""")
def longest_consecutive_run(t):
    return confidence.longest_run(t("orders").withColumn("i", F.floor(F.col("o_orderkey") / 40)), "o_custkey", "i")


SPANS = "o as (select o_custkey g, date_diff('day', date '1970-01-01', o_orderdate::date) a, date_diff('day', date '1970-01-01', o_orderdate::date) + 1 + o_orderkey % 60 b from orders)"


@query(f"""with {SPANS}, r as (select g, a, b, max(b) over (partition by g order by a, b rows between unbounded preceding and 1 preceding) m from o)
select g as o_custkey, sum(greatest(0, b - greatest(a, coalesce(m, a))))::bigint covered from r group by 1""")
def interval_union_length(t):
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    return confidence.union_length(t("orders").select("o_custkey", day.alias("a"), (day + 1 + F.col("o_orderkey") % 60).alias("b")), "o_custkey", "a", "b")


# --- text ------------------------------------------------------------------------------------------------------------------


def _indic(t):
    """Numbers written in Arabic-Indic digits, made from a numeric column."""
    return t("part").select("p_partkey", F.translate(F.concat(F.lit("سعر "), F.format_number("p_retailprice", 2)), "0123456789.,", "٠١٢٣٤٥٦٧٨٩٫٬").alias("raw"))


@query("select p_partkey, 'سعر ' || format('{:,.2f}', p_retailprice) as folded from part")
def canon_fold_numerals(t):
    return _indic(t).select("p_partkey", text.fold_numerals(F.col("raw")).alias("folded"))


@query(r"""select doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ([,.;:!?)\]])', '\1', 'g'), '([(\[]) ', '\1', 'g'), ' ')) as canon_sha from documents""")
def canon_spacing(t):
    ascii_ = F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")
    return t("documents").select("doc_id", F.sha2(text.spacing(ascii_), 256).alias("canon_sha"))


@query("select c_custkey, case when c_custkey % 2 = 0 then '-' else '' end || format('{:,.2f}', abs(c_acctbal)) as folded from customer")
def canon_paren_neg(t):
    amount = F.format_number(F.abs("c_acctbal"), 2)
    return t("customer").select("c_custkey", text.fold_paren_negatives(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("("), amount, F.lit(")"))).otherwise(amount)).alias("folded"))


@query("select p_partkey, 'سعر ' || format('{:,.2f}', p_retailprice) as canon, 'text/fold_numerals' as fired from part")
def canon_trace(t):
    value, fired = text.traced(F.col("raw"), unicode=False)
    return _indic(t).select("p_partkey", value.alias("canon"), F.array_join(fired, ",").alias("fired"))


@query()
def canon_full_nfkc(t):
    return t("documents").select("doc_id", text.canonical(F.col("text"), letters=True).alias("canon"))


@query("""select p_partkey, case p_partkey % 5 when 0 then p_retailprice when 1 then p_retailprice when 2 then p_retailprice when 3 then 0 else -1 end::double as amount from part""")
def parse_amount_shapes(t):
    price, k = F.col("p_retailprice"), F.col("p_partkey") % 5
    plain = F.replace(F.format_number(price, 2), F.lit(","), F.lit(""))
    shape = F.when(k == 0, F.format_number(price, 2)).when(k == 1, plain).when(k == 2, F.replace(plain, F.lit("."), F.lit(","))).when(k == 3, "-").otherwise("n.a.")
    return t("part").select("p_partkey", F.coalesce(numbers.parse_amount(shape).cast("double"), F.lit(-1.0)).alias("amount"))


@query("""select l_orderkey, l_linenumber, l_partkey, abs(p_retailprice * l_quantity - l_extendedprice) <= 0.01 * abs(p_retailprice * l_quantity) as ok,
round(greatest(0, 1 - abs(p_retailprice * l_quantity - l_extendedprice) / abs(p_retailprice * l_quantity)), 6) as similarity from lineitem join part on l_partkey = p_partkey""")
def numbers_match_1pct(t):
    both = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("e", F.col("p_retailprice") * F.col("l_quantity"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", numbers.numbers_match(F.col("e"), F.col("l_extendedprice")).alias("ok"), F.round(numbers.numeric_similarity(F.col("e"), F.col("l_extendedprice")), 6).alias("similarity"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso from orders")
def date_to_iso(t):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    written = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "d MMM yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))
    return t("orders").select("o_orderkey", numbers.iso_date(written).alias("iso"))


BAGS = r"""w as (select doc_id, text, lower(text) t from documents),
a as (select doc_id, x as word, count(*) n from (select doc_id, unnest(regexp_extract_all(t, '[a-z0-9]+')) x from w) group by 1, 2),
b as (select doc_id, x as word, count(*) n from (select doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, 'th', 't', 'g')), '[a-z0-9]+')) x from w) group by 1, 2),
j as (select coalesce(a.doc_id, b.doc_id) doc_id, coalesce(a.n, 0) p, coalesce(b.n, 0) q from a full join b on a.doc_id = b.doc_id and a.word = b.word)"""


def _bags(t, *keep):
    return t("documents").select(*keep, text.words(F.col("text")).alias("a"), text.words(F.regexp_replace("text", "th", "t")).alias("b"))


@query(f"""with {BAGS} select doc_id, round(case when sum(p) > 0 then sum(greatest(p - q, 0)) / sum(p) else 0 end, 6) missing, round(case when sum(q) > 0 then sum(greatest(q - p, 0)) / sum(q) else 0 end, 6) unexpected,
sum((p > 0 and q > p)::int)::bigint n_too_many from j group by 1""")
def word_bag_percent(t):
    return rules.missing_words(_bags(t, "doc_id"), "doc_id", "a", "b")


DIGITS = ", ".join(f"(len(text) - len(replace(text, '{d}', '')))" for d in range(10))


@query(f"""with x as (select doc_id, text, regexp_replace(text, '[13]', '', 'g') said from documents), d as (select doc_id, [{DIGITS}] a, [{DIGITS.replace('text', 'said')}] b from x)
select doc_id, round(case when list_sum(a) > 0 then list_sum([least(a[i], b[i]) for i in range(1, 11)]) / list_sum(a) else 1 end, 6) as score from d""")
def digit_bag_percent(t):
    docs = t("documents").withColumn("said", F.regexp_replace("text", "[13]", ""))
    return docs.select("doc_id", F.round(rules.digit_bag(F.col("text"), F.col("said")), 6).alias("score"))


@query()
def sentence_bag_missing(t):
    docs = t("documents").withColumn("said", F.regexp_replace("text", "the", "teh"))
    return docs.select("doc_id", F.round(rules.sentence_bag(F.col("text"), F.col("said")), 6).alias("missing"))


@query("select doc_id, contains(lower(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 'of the') as has, instr(text, 'the') > 0 and instr(text, 'and') > 0 and instr(text, 'the') < length(text) - 1 - instr(reverse(text), 'dna') as ordered from documents")
def text_presence_and_order(t):
    return t("documents").select("doc_id", rules.presence(F.col("text"), F.lit("of the")).alias("has"), rules.in_order(F.col("text"), F.lit("the"), F.lit("and")).alias("ordered"))


@query(r"select doc_id, not regexp_matches(coalesce(text, ''), '[\pL\pN]') as blank from documents")
def baseline_blank(t):
    return t("documents").select("doc_id", rules.is_blank(F.col("text")).alias("blank"))


@query("""select a.p_partkey, round(case when greatest(length(a.p_name), length(b.p_name)) = 0 then 1 else 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) end, 6) as similarity
from part a join part b on b.p_partkey = a.p_partkey + 1""")
def text_similarity_lev(t):
    other = t("part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("said"))
    return t("part").join(other, "p_partkey").select("p_partkey", F.round(text.similarity(F.col("p_name"), F.col("said")), 6).alias("similarity"))


@query(f"""with {BAGS}, s as (select doc_id, sum(least(p, q)) m, sum(p) p, sum(q) q from j group by 1)
select doc_id, round(case when q > 0 then m / q else 0 end, 6) as precision, round(case when p > 0 then m / p else 0 end, 6) recall, round(case when p + q > 0 then 2 * m / (p + q) else 0 end, 6) f1 from s""")
def token_f1(t):
    return layout.token_f1(_bags(t, "doc_id"), "doc_id", "a", "b")


@query(r"""select page_id, i::bigint as place, substr(h, 3, 1)::int as level from (select page_id, unnest(x) h, generate_subscripts(x, 1) - 1 i from (select page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') x from pages))""")
def html_title_level(t):
    return t("pages").select("page_id", F.posexplode(rules.title_levels(F.col("html"))).alias("place", "x")).select("page_id", F.col("place").cast("long").alias("place"), "x.level")


@query(r"""select page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) as text_sha from pages""")
def html_text_strip(t):
    return t("pages").select("page_id", F.sha2(text.strip_tags(F.col("html")), 256).alias("text_sha"))


@query("""select page_id, count(*) n_links, count(distinct x) n_distinct from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) x from pages) group by 1""")
def html_link_extract(t):
    return t("pages").select("page_id", F.explode(rules.links(F.col("html"))).alias("x")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("x").alias("n_distinct"))


@query("""with x as (select conv_id, turn // 2 as pair, max(case when turn % 2 = 0 then text end) a, max(case when turn % 2 = 1 then text end) b from conversations group by 1, 2)
select conv_id, pair::bigint as pair, coalesce(trim(regexp_replace(regexp_replace(lower(a), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'), ' ') = trim(regexp_replace(regexp_replace(lower(b), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'), ' '), false) as ok from x""")
def qa_answer_compare(t):
    turn = lambda n: F.max(F.when(F.col("turn") % 2 == n, F.col("text")))
    both = t("conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).cast("long").alias("pair")).agg(turn(0).alias("a"), turn(1).alias("b"))
    return both.select("conv_id", "pair", F.coalesce(rules.answer_matches(F.col("a"), F.col("b")), F.lit(False)).alias("ok"))


# --- tables ----------------------------------------------------------------------------------------------------------------


def _nation_tables(t):
    """A table of nations for each region, as HTML in odd regions and as a pipe table in even ones."""
    pairs = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    by = t("nation").groupBy("n_regionkey").agg(pairs.alias("x"))
    html = F.concat(F.lit("<p>x</p><table><tr><th>key</th><th>name</th></tr>"), F.array_join(F.transform("x", lambda r: F.concat(F.lit("<tr><td>"), r["n_nationkey"].cast("string"), F.lit("</td><td>"), r["n_name"], F.lit("</td></tr>"))), ""), F.lit("</table>"))
    pipe = F.concat(F.lit("text\n| key | name |\n|---|---|\n"), F.array_join(F.transform("x", lambda r: F.concat(F.lit("| "), r["n_nationkey"].cast("string"), F.lit(" | "), r["n_name"], F.lit(" |"))), "\n"))
    return by.select("n_regionkey", F.when(F.col("n_regionkey") % 2 == 1, html).otherwise(pipe).alias("markup"))


GRID = """r as (select n_regionkey, n_nationkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) i from nation),
g as (select distinct n_regionkey, 0 as row, 0 as col, 'key' as text from nation union all select distinct n_regionkey, 0, 1, 'name' from nation union all select n_regionkey, i, 0, n_nationkey::varchar from r union all select n_regionkey, i, 1, n_name from r)"""


@query(f"with {GRID} select n_regionkey, 0 as tbl, row::int as row, col::int as col, text, row = 0 as is_th from g")
def extract_tables_udtf(t):
    return tables.cells(_nation_tables(t), "n_regionkey", "markup").select("n_regionkey", "tbl", "row", "col", "text", "is_th")


@query(f"with {GRID} select n_regionkey, (max(row) + 1)::bigint n_rows, (max(col) + 1)::bigint n_cols, count(*) n_cells from g group by 1")
def num_rows_cols(t):
    return tables.sizes(tables.cells(_nation_tables(t), "n_regionkey", "markup"), ["n_regionkey"])


@query(f"""with {GRID} select n_regionkey, row::int as row, col::int as col, text, lead(text) over (partition by n_regionkey, row order by col) as right, lead(text) over (partition by n_regionkey, col order by row) as below from g""")
def table_adjacent(t):
    return tables.neighbours(tables.cells(_nation_tables(t), "n_regionkey", "markup"), ["n_regionkey"]).select("n_regionkey", "row", "col", "text", "right", "below")


LINES = "case when l_partkey % 5 = 0 then '' else l_partkey::varchar end a, case when l_partkey % 5 = 0 and l_suppkey % 2 = 0 then '' else l_suppkey::varchar end b, case when l_partkey % 5 = 0 then '' else l_linenumber::varchar end c"


@query(f"""with x as (select l_orderkey o, l_linenumber n, l_partkey p, {LINES} from lineitem),
y as (select *, (a <> '')::int + (b <> '')::int + (c <> '')::int f from x), k as (select *, max((f > 1)::int) over (partition by o) m from y)
select o as l_orderkey, count(*) * 3 as n_cells from k where f > 1 or m = 0 group by 1""")
def structural_canon(t):
    blank = F.col("l_partkey") % 5 == 0
    cell = lambda i, c, empty: F.struct(F.lit(i).alias("col"), F.when(empty, "").otherwise(F.col(c).cast("string")).alias("text"))
    row = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*[c for c in t("lineitem").columns if c != "l_orderkey"])).cast("long")
    grid = t("lineitem").withColumn("row", row).select("l_orderkey", "row", F.explode(F.array(cell(0, "l_partkey", blank), cell(1, "l_suppkey", blank & (F.col("l_suppkey") % 2 == 0)), cell(2, "l_linenumber", blank))).alias("x")).select("l_orderkey", "row", "x.*")
    return tables.without_sections(grid, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_cells"))


def _copy(t):
    """Supplier cells and a copy of them in which every seventh is null and every eleventh differs."""
    true = tables.as_cells(t("supplier"), "s_suppkey", ["s_name", "s_nationkey", "s_acctbal"])
    k = F.col("row") * 3 + F.col("col")
    said = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.concat(F.col("text"), F.lit("9"))).otherwise(F.col("text"))
    return true, true.withColumn("text", said).where(k % 13 != 0)


CELLS = """c as (select s_suppkey as row, 0 as col, s_name as text from supplier union all select s_suppkey, 1, s_nationkey::varchar from supplier union all select s_suppkey, 2, s_acctbal::varchar from supplier),
d as (select row, col, text, row * 3 + col as k from c), e as (select *, case when k % 13 = 0 or k % 7 = 0 then null when k % 11 = 0 then text || '9' else text end said from d)"""


@query(f"""with {CELLS}, n as (select *, regexp_matches(text, '^-?[0-9]+(\\.[0-9]+)?$') num, regexp_replace(text, '[^0-9-]', '', 'g') x, regexp_replace(coalesce(said, ''), '[^0-9-]', '', 'g') y from e)
select count(*) n_cells, count(said) n_covered, sum(num::int)::bigint n_numeric, sum((num and x = y)::int)::bigint n_exact, sum(case when num then levenshtein(x, y) else 0 end)::bigint n_edits, sum(case when num then length(x) else 0 end)::bigint n_digits from n""")
def cell_coverage(t):
    return tables.coverage(*_copy(t), ["row", "col"])


@query(f"with {CELLS} select 0::bigint null_kept, 0::bigint fabricated, sum((said is null)::int)::bigint dropped, count(said) value_kept from e")
def null_confusion(t):
    return tables.null_confusion(*_copy(t), ["row", "col"])


@query("""with s as (select l_orderkey k, sum(l_quantity::decimal(28, 10)) a, count(*) n from lineitem group by 1)
select o_orderkey, coalesce(n, 0) + 1 as n_terms, o_orderkey % 5 <> 0 as evaluable, o_orderkey % 5 <> 0 and coalesce(a, 0) = case when o_orderkey % 3 = 0 then 1 else coalesce(a, 0) end as reconciles from orders left join s on k = o_orderkey""")
def arithmetic_consistency(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("addend").alias("role"), F.col("l_quantity").cast(numbers.AMOUNT).alias("amount"))
    sums = lines.groupBy("o_orderkey").agg(F.sum("amount").cast(numbers.AMOUNT).alias("s"))
    total = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 3 == 0, F.lit(1)).otherwise(F.coalesce("s", F.lit(0)))
    totals = t("orders").select("o_orderkey").join(sums, "o_orderkey", "left").select("o_orderkey", F.lit("total").alias("role"), total.cast(numbers.AMOUNT).alias("amount"))
    return tables.relations(lines.unionByName(totals), ["o_orderkey"]).select("o_orderkey", "n_terms", "evaluable", "reconciles")


# --- alignment -------------------------------------------------------------------------------------------------------------

PAIRS = "a as (select l_orderkey o, l_linenumber n, l_partkey p, l_suppkey s from lineitem), b as (select o, n + 100 as n, p, case when p % 7 = 0 then s + 1 else s end s from a)"


def _lines(t):
    a = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return a, a.withColumns({"n": F.col("n") + 100, "s": F.when(F.col("p") % 7 == 0, F.col("s") + 1).otherwise(F.col("s"))})


@query(f"""with {PAIRS}, x as (select *, row_number() over (partition by o, p, s order by n) r from a), y as (select *, row_number() over (partition by o, p, s order by n) r from b)
select o as l_orderkey, count(*) n_peeled from x join y using (o, p, s, r) group by 1""")
def exact_row_peel(t):
    return align.peel(*_lines(t), "l_orderkey", "n", ["p", "s"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_peeled"))


@query("""with a as (select o_custkey, o_orderpriority, o_orderkey k, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) r from orders where o_orderkey % 2 = 0),
b as (select o_custkey, o_orderpriority, o_orderkey k, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) r from orders where o_orderkey % 2 = 1)
select o_custkey, o_orderpriority, coalesce(a.k, -1) as true_row, coalesce(b.k, -1) as predicted_row from a full join b using (o_custkey, o_orderpriority, r)""")
def identity_key_alignment(t):
    half = lambda r: t("orders").where(F.col("o_orderkey") % 2 == r)
    return align.by_identity(half(0), half(1), ["o_custkey", "o_orderpriority"], "o_orderkey").fillna(-1, ["true_row", "predicted_row"])


@query("""with a as (select o_custkey, min(o_orderkey) k from orders where o_orderkey % 2 = 0 group by 1 having count(*) = 1), b as (select o_custkey, min(o_orderkey) k from orders where o_orderkey % 2 = 1 group by 1 having count(*) = 1)
select o_custkey, a.k as true_row, b.k as predicted_row from a join b using (o_custkey)""")
def unique_key_alignment(t):
    half = lambda r: t("orders").where(F.col("o_orderkey") % 2 == r)
    return align.unique_identity(half(0), half(1), "o_custkey", "o_orderkey")


@query()
def hungarian_rows(t):
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*[c for c in t("lineitem").columns if c != "l_orderkey"])).cast("long")
    a = t("lineitem").select("l_orderkey", number.alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return align.assign(a, a.withColumn("s", F.when(F.col("p") % 7 == 0, F.col("s") + 1).otherwise(F.col("s"))), "l_orderkey", "n", ["p", "s"])


@query("""select p_partkey, round(jaro_winkler_similarity(p_name, p_type), 6) as similarity from part""")
def jaro_winkler(t):
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(kernels.jaro_winkler(x, y), 6) for x, y in zip(a, b, strict=True)])

    return t("part").select("p_partkey", score("p_name", "p_type").alias("similarity"))


# --- JSON ------------------------------------------------------------------------------------------------------------------


@query("""select event_id, 'k' as path, 'number' as kind, json_extract_string(props, '$.k') as value from events where json_exists(props, '$.k')""")
def json_leaves(t):
    return jsontree.leaves(t("events"), "event_id", "props").select("event_id", "path", "kind", "value")


@query("""select event_id, 1::bigint n_leaves, case when event_id % 3 = 0 then 0.0 else 1.0 end::double as score from events where json_exists(props, '$.k')""")
def json_subset_match(t):
    true = jsontree.flat_leaves(t("events"), "event_id", "props")
    said = true.withColumn("value", F.when(F.col("event_id") % 3 == 0, F.concat("value", F.lit("0"))).otherwise(F.col("value")))
    return jsontree.subset(true, said, "event_id")


# --- layout ----------------------------------------------------------------------------------------------------------------

BOXES = "select vec_id as id, vec_id % 17 as page, abs(embedding[1]::double) x0, abs(embedding[2]::double) y0, abs(embedding[1]::double) + 0.05 + abs(embedding[3]::double) x1, abs(embedding[2]::double) + 0.05 + abs(embedding[4]::double) y1, label from embeddings"


def _boxes(t):
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    return t("embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 17).alias("page"), e(0).alias("x0"), e(1).alias("y0"), (e(0) + 0.05 + e(2)).alias("x1"), (e(1) + 0.05 + e(3)).alias("y1"), "label")


@query(f"""with b as ({BOXES}), p as (select a.page, a.id a_id, c.id b_id, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) i,
(a.x1 - a.x0) * (a.y1 - a.y0) s, (c.x1 - c.x0) * (c.y1 - c.y0) r from b a join b c on a.page = c.page and a.id < c.id)
select page, a_id, b_id, round(i / (s + r - i), 6) iou from p where i / (s + r - i) > 0.3""")
def iou_range_join(t):
    b = _boxes(t)
    return layout.overlapping(b, b, "page", least=0.3).where("a_id < b_id").withColumn("iou", F.round("iou", 6))


@query()
def greedy_match_ap(t):
    b = _boxes(t)
    predicted, true = b.where("id % 2 = 0").withColumn("score", F.col("x0")), b.where("id % 2 = 1")
    hits = layout.greedy(predicted, true, "page", 0.3)
    return layout.average_precision(hits, "page", true.groupBy("page").agg(F.count(F.lit(1)).alias("n_true")))


@query(f"""with b as ({BOXES}) select id, round((x1 - x0) * (y1 - y0), 6) area, round(case when (x1 - x0) * (y1 - y0) > 0 then greatest(least(x1, 0.1) - x0, 0) * greatest(least(y1, 0.1) - y0, 0) / ((x1 - x0) * (y1 - y0)) else 0 end, 6) ioa from b""")
def box_area_ioa(t):
    b, window = geometry.box(""), tuple(F.lit(v) for v in (0.0, 0.0, 0.1, 0.1))
    return _boxes(t).select("id", F.round(geometry.area(b), 6).alias("area"), F.round(geometry.ioa(b, window), 6).alias("ioa"))


# --- gates -----------------------------------------------------------------------------------------------------------------


@query("""select * from (select p_partkey, unnest([case when p_size > 45 then 'too_large' end, case when p_name like 'small%' then 'small' end, case when p_retailprice < 905 then 'cheap' end]) as defect from part) where defect is not null""")
def schema_defects(t):
    checks = {"too_large": F.col("p_size") > 45, "small": F.col("p_name").startswith("small"), "cheap": F.col("p_retailprice") < 905}
    return gates.defects(t("part"), "p_partkey", checks)


@query("select item_id, sha256(coalesce(text, '')) as sha256 from benchmark")
def freeze_sha256(t):
    return gates.freeze(t("benchmark"), "item_id", "text")


@query("select doc_id from documents where sha256(coalesce(text, '')) in (select sha256(coalesce(text, '')) from benchmark)")
def training_exclusion(t):
    return gates.leaked(t("documents").select("doc_id", "text"), t("benchmark").select("text"), "text").select("doc_id")


@query(r"""select doc_id, len(regexp_extract_all(text, '[ÃÂØÙ][\x{80}-\x{BF}]'))::bigint pairs from documents where len(regexp_extract_all(text, '[ÃÂØÙ][\x{80}-\x{BF}]')) >= 2""")
def mojibake_guard(t):
    return gates.garbled(t("documents"), "doc_id", "text")


# --- grounding and scoring ---------------------------------------------------------------------------------------------------


@query(f"""with b as ({BOXES}), p as (select a.page, a.id, c.id as block, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) / ((a.x1 - a.x0) * (a.y1 - a.y0)) as ioa
from b a join b c on a.page = c.page and a.id % 2 = 0 and c.id % 2 = 1), r as (select *, row_number() over (partition by page, id order by ioa desc, block) as n from p where ioa >= 0.3)
select page, id, block, round(ioa, 6) as ioa from r where n = 1""")
def best_attribution_block(t):
    b = _boxes(t)
    return grounding.best_block(b.where("id % 2 = 0"), b.where("id % 2 = 1"), "page").withColumn("ioa", F.round("ioa", 6))


@query(f"""with {BAGS}, s as (select d.source, sum(least(p, q)) m, sum(p) p, sum(q) q from j join documents d using (doc_id) group by 1)
select source, round(case when q > 0 then m / q else 1 end, 6) lap, round(case when p > 0 then m / p else 1 end, 6) lar from s""")
def lap_lar(t):
    return grounding.attributed(_bags(t, "source"), ["source"], "a", "b")


@query("""with a as (select l_orderkey k, l_linenumber n, min(l_returnflag) c from lineitem where l_partkey % 10 <> 0 group by 1, 2), b as (select l_orderkey k, l_linenumber n, min(l_linestatus) c from lineitem where l_partkey % 10 <> 1 group by 1, 2)
select coalesce(a.c, 'background') true_class, coalesce(b.c, 'background') said_class, count(*) n from a full join b using (k, n) group by 1, 2""")
def class_confusion(t):
    side = lambda c, r: t("lineitem").where(F.col("l_partkey") % 10 != r).groupBy("l_orderkey", "l_linenumber").agg(F.min(c).alias("class"))
    return grounding.confusion(side("l_returnflag", 0), side("l_linestatus", 1), ["l_orderkey", "l_linenumber"], "class")


HITS = "h as (select event_type, t, event_id as id, value as score, hash_ok from (select event_type, event_id, value, unnest([3, 5, 7]) t from events), lateral (select event_id % t = 0 as hash_ok))"


@query(f"""with {HITS}, n as (select event_type, count(*) // 2 n_true from events group by 1),
r as (select event_type, t, hash_ok, row_number() over w as k, sum(hash_ok::int) over w as c from h window w as (partition by event_type, t order by score desc, id rows unbounded preceding)),
a as (select event_type, t, sum(case when hash_ok then c / k else 0 end) s from r group by 1, 2), m as (select t, avg(s / n_true) ap from a join n using (event_type) where n_true > 0 group by 1)
select round(avg(ap), 6) as map, count(*) n_thresholds from m""")
def map_over_thresholds(t):
    hits = t("events").select("event_type", F.col("event_id").alias("id"), F.col("value").alias("score"), F.explode(F.array(F.lit(3), F.lit(5), F.lit(7))).alias("t")).withColumn("matched", F.col("id") % F.col("t") == 0)
    n = t("events").groupBy("event_type").agg(F.floor(F.count(F.lit(1)) / 2).alias("n_true"))
    return grounding.mean_average_precision(hits, "event_type", "t", n)


@query(r"""with h as (select page_id, i::bigint - 1 as place, substr(x[i], 3, 1)::int as level from (select page_id, x, unnest(range(1, len(x) + 1)) i from (select page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') x from pages)))
select c.page_id, c.place, coalesce(max(p.place), -1) as parent from h c left join h p on p.page_id = c.page_id and p.place < c.place and p.level < c.level group by 1, 2""")
def title_hierarchy(t):
    titles = t("pages").select("page_id", F.posexplode(rules.title_levels(F.col("html"))).alias("place", "x")).select("page_id", F.col("place").cast("long").alias("place"), "x.level")
    return grounding.title_edges(titles, "page_id", "place", "level")


@query("""with a as (select o_custkey, o_orderpriority x, count(*) a from orders where o_orderkey % 2 = 0 group by 1, 2), b as (select o_custkey, o_orderpriority x, count(*) b from orders where o_orderkey % 2 = 1 group by 1, 2)
select o_custkey, round(sum(least(a, coalesce(b, 0))) / sum(a), 6) score from a left join b using (o_custkey, x) group by 1""")
def header_content_bag(t):
    half = lambda r: t("orders").where(F.col("o_orderkey") % 2 == r)
    return grounding.header_bag(half(0), half(1), "o_custkey", "o_orderpriority")


@query("""with a as (select o_custkey k, list(distinct o_orderpriority) a from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey k, list(distinct o_orderpriority) b from orders where o_orderkey % 2 = 1 group by 1),
j as (select k, coalesce(a, []) a, coalesce(b, []) b from a full join b using (k))
select k as o_custkey, round(2 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) f1 from j""")
def association_f1(t):
    half = lambda r: t("orders").where(F.col("o_orderkey") % 2 == r)
    return grounding.association_f1(half(0), half(1), "o_custkey", "o_orderpriority")


@query("""with x as (select nullif(event_type, '') system, event_id % 3 p, case when value > 50 then 'failed' else 'ok' end st, value v from events)
select system, round(avg(case when p = 0 then case when st = 'failed' then 0 else v end end), 6) as raw, round(avg(case when p = 1 then case when st = 'failed' then 0 else v end end), 6) as "text",
round(avg(case when p = 2 then case when st = 'failed' then 0 else v end end), 6) as struct, 'trm' as metric from x group by 1""")
def leaderboard_by_pass(t):
    pass_ = F.element_at(F.array(*[F.lit(p) for p in scoring.PASSES]), (F.col("event_id") % 3 + 1).cast("int"))
    rows = t("events").select(F.col("event_type").alias("system"), pass_.alias("pass"), F.lit("trm").alias("metric"), F.when(F.col("value") > 50, "failed").otherwise("ok").alias("status"), "value")
    return scoring.board(rows, "trm")


@query("select p_partkey, round(case when p_partkey % 4 = 0 then 0.0 when p_partkey % 4 = 1 then 1.0 / 2 else 1.0 end, 6)::double as fidelity from part")
def script_fidelity(t):
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, "١٢ ٣").when(k == 1, "12 ٣").otherwise("12 3")
    return scoring.fidelity(t("part").select("p_partkey", F.lit("1 2 ٣").alias("a"), said.alias("b")), "p_partkey", "a", "b")


@query("""select p_partkey, case when p_size > 45 then 'too_large' when p_name like 'small%' then 'small' else 'admitted' end as verdict from part""")
def admission_first_failing(t):
    checks = {"too_large": F.col("p_size") > 45, "small": F.col("p_name").startswith("small")}
    return t("part").select("p_partkey", F.coalesce(gates.first_failing(checks), F.lit("admitted")).alias("verdict"))


@query("""select c_custkey as row, c - 1 as new_col, [0, 1, 2][c] as col from customer, unnest([1, 2, 3]) u(c)""")
def table_column_order(t):
    grid = tables.as_cells(t("customer"), "c_custkey", ["c_name", "c_acctbal", "c_nationkey"]).withColumnRenamed("row", "doc").withColumn("row", F.lit(0))
    return tables.column_order(grid, ["doc"]).select(F.col("doc").alias("row"), "col", "new_col")


# --- evidence and adapters -----------------------------------------------------------------------------------------------------


@query("""with x as (select c_custkey k, c_name a, case when c_custkey % 3 = 0 then upper(c_name) when c_custkey % 3 = 1 then c_name || ' x' else '' end b from customer)
select k as c_custkey, a = b as exact, lower(a) = lower(b) as case_insensitive, case when b = '' then false else contains(lower(b), lower(a)) end as substring from x""")
def evidence_comparators(t):
    k, a = F.col("c_custkey") % 3, F.col("c_name")
    b = F.when(k == 0, F.upper(a)).when(k == 1, F.concat(a, F.lit(" x"))).otherwise("")
    return t("customer").select("c_custkey", *[evidence.compare(c, a, b).alias(c) for c in ("exact", "case_insensitive", "substring")])


@query("""with x as (select p_partkey k, p_retailprice e, case p_partkey % 3 when 0 then p_retailprice * 1000 when 1 then p_retailprice * 1.5 else p_retailprice end g from part)
select k as p_partkey, round(case when k % 3 = 0 then 1 when k % 3 = 1 then greatest(0, 1 - abs(e - g) / e) else 1 end, 4) as score from x""")
def chart_values(t):
    k, e = F.col("p_partkey") % 3, F.col("p_retailprice")
    given = F.when(k == 0, e * 1000).when(k == 1, e * 1.5).otherwise(e)
    return t("part").select("p_partkey", F.round(evidence.chart_number(F.format_number(e, 2), F.format_number(given, 4)), 4).alias("score"))


@query("""with a as (select o_custkey, list(distinct o_orderpriority) a, list(distinct o_orderstatus) s, list(distinct case when o_orderkey % 2 = 0 then o_orderpriority end) b from orders group by 1)
select o_custkey, len(list_intersect(a, b)) >= 2 as two, len(list_intersect(a, b)) = len(a) as full from a""")
def evidence_sets(t):
    some = F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    sets = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), some.alias("b"))
    return sets.select("o_custkey", evidence.covered(F.col("a"), F.col("b"), least=2).alias("two"), evidence.covered(F.col("a"), F.col("b"), exhaustive=True).alias("full"))


@query("""select n_nationkey, n_nationkey % 2 = 0 as bold, n_nationkey % 3 = 0 as heading from nation""")
def formatting_rules(t):
    k = F.col("n_nationkey")
    marked = F.concat(F.when(k % 3 == 0, "# some title\n").otherwise("x\n"), F.when(k % 2 == 0, "a **bold phrase** here").otherwise("a bold phrase here"))
    return t("nation").select("n_nationkey", evidence.is_formatted(marked, "bold phrase", "bold").alias("bold"), evidence.is_formatted(marked, "some title", "heading").alias("heading"))


@query("""select event_id, case when event_id % 4 = 0 then '$.k: not integer' else '$.z: not allowed' end as violation from events where json_exists(props, '$.k') and event_id % 4 < 2""")
def schema_validation(t):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}, "additionalProperties": False}
    r = F.col("event_id") % 4
    props = F.when(r == 0, F.replace("props", F.lit('"k": '), F.lit('"k": 0.'))).when(r == 1, F.replace("props", F.lit('"k"'), F.lit('"z": 1, "k"'))).otherwise(F.col("props"))
    return evidence.schema_violations(t("events").withColumn("props", props), "event_id", "props", schema)


@query("""select vec_id, 1 as page, 'Text' as label, round(abs(embedding[1]::double), 6) x0, round(abs(embedding[2]::double), 6) y0 from embeddings""")
def layout_adapter(t):
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    raw = F.to_json(F.struct(F.array(F.struct(F.lit("Text").alias("BlockType"), F.lit(1).alias("Page"), F.struct(F.struct(e(0).alias("Left"), e(1).alias("Top"), F.lit(0.1).alias("Width"), F.lit(0.1).alias("Height")).alias("BoundingBox")).alias("Geometry"))).alias("Blocks")))
    spec = adapters.Spec("Blocks[]", "Geometry.BoundingBox", "BlockType", "Text", page="Page", form="ltwh")
    return adapters.layouts(t("embeddings").select("vec_id", raw.alias("raw")), "vec_id", "raw", spec).select("vec_id", "page", "label", F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"))


@query("""select vec_id, case label % 3 when 0 then 'heading' when 1 then 'table' else 'other' end as "class" from embeddings""")
def layout_label_mapping(t):
    raw = F.element_at(F.array(F.lit("Title"), F.lit("Table"), F.lit("Unknown")), (F.col("label") % 3 + 1).cast("int"))
    return layout.to_classes(t("embeddings").select("vec_id", raw.alias("label"))).select("vec_id", "class")


# --- keys and values of alignment ----------------------------------------------------------------------------------------------

HALVES = "a as (select p_partkey k, p_name n, p_retailprice::varchar r, p_size::varchar s from part where p_partkey % 3 <> 0), b as (select p_partkey + 100000 k, p_name n, p_retailprice::varchar r, p_size::varchar s from part where p_partkey % 3 <> 1)"


def _halves(t):
    part = t("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.col("p_retailprice").cast("string").alias("r"), F.col("p_size").cast("string").alias("s"))
    return part.where("k % 3 <> 0"), part.where("k % 3 <> 1").withColumn("k", F.col("k") + 100000)


@query(f"""with {HALVES}, x as (select 'n' field, n v, 1 a, 0 b from a union all select 'n', n, 0, 1 from b union all select 'r', r, 1, 0 from a union all select 'r', r, 0, 1 from b union all select 's', s, 1, 0 from a union all select 's', s, 0, 1 from b),
y as (select field, v, sum(a) a, sum(b) b from x where v is not null group by 1, 2),
z as (select field, round(sum((a > 0)::int) / sum(a), 6) unique_true, round(sum((b > 0)::int) / sum(b), 6) unique_predicted, round(sum((a > 0 and b > 0)::int) / least(sum((a > 0)::int), sum((b > 0)::int)), 6) overlap from y group by 1)
select *, unique_true >= 0.9 and unique_predicted >= 0.9 and overlap >= 0.2 as usable from z""")
def inferred_key_quality(t):
    return align.key_quality(*_halves(t), ["n", "r", "s"])


@query(f"""with {HALVES}, u as (select 'r' f, r v, min(k) k from a group by 1, 2 having count(*) = 1 union all select 'n', n, min(k) from a group by 1, 2 having count(*) = 1),
w as (select 'r' f, r v, min(k) k from b group by 1, 2 having count(*) = 1 union all select 'n', n, min(k) from b group by 1, 2 having count(*) = 1),
o as (select u.k t, w.k p, count(*) c from u join w using (f, v) group by 1, 2), x as (select *, row_number() over (partition by t order by c desc, p) r from o), y as (select *, row_number() over (partition by p order by c desc, t) q from x where r = 1)
select t as true_row, p as predicted_row, c as n_shared from y where q = 1""")
def distinctive_value_alignment(t):
    return align.distinctive(*_halves(t), "k", ["r", "n"])


# --- rules over cells and markup -----------------------------------------------------------------------------------------------


@query(f"""with {GRID}, k as (select n_regionkey, r.n_nationkey, r.n_name, row_number() over (partition by n_regionkey order by n_nationkey) i from nation r),
rules as (select n_regionkey, n_nationkey * 10 + j as rule, j, n_nationkey, n_name from k, unnest([0, 1, 2, 3]) u(j))
select n_regionkey, rule, j <> 3 as passed from rules""")
def table_relation_rules(t):
    wanted = F.array(
        F.struct(F.lit(0).alias("j"), F.lit("adjacent_right").alias("kind"), F.col("n_nationkey").cast("string").alias("anchor"), F.col("n_name").alias("other")),
        F.struct(F.lit(1).alias("j"), F.lit("top_header").alias("kind"), F.col("n_name").alias("anchor"), F.lit("name").alias("other")),
        F.struct(F.lit(2).alias("j"), F.lit("same_column").alias("kind"), F.lit("key").alias("anchor"), F.col("n_nationkey").cast("string").alias("other")),
        F.struct(F.lit(3).alias("j"), F.lit("adjacent_left").alias("kind"), F.col("n_nationkey").cast("string").alias("anchor"), F.col("n_name").alias("other")),
    )
    asked = t("nation").select("n_regionkey", "n_nationkey", F.explode(wanted).alias("x")).select("n_regionkey", (F.col("n_nationkey") * 10 + F.col("x.j")).alias("rule"), "x.kind", "x.anchor", "x.other")
    return table_rules.relations(asked, tables.cells(_nation_tables(t), "n_regionkey", "markup"), "n_regionkey", least=0.95)


@query("""select r_regionkey as n_regionkey, j as rule, case j when 0 then n = 5 when 1 then true else false end as passed
from region join (select n_regionkey, count(*) n from nation group by 1) on n_regionkey = r_regionkey, unnest([0, 1, 2]) u(j)""")
def table_size_rules(t):
    rule = F.explode(F.array(*[F.struct(F.lit(j).alias("rule"), F.lit(r).cast("int").alias("n_rows"), F.lit(c).cast("int").alias("n_cols")) for j, (r, c) in enumerate([(6, 2), (None, 2), (None, 3)])]))
    asked = t("region").select(F.col("r_regionkey").alias("n_regionkey"), rule.alias("x")).select("n_regionkey", "x.*")
    return table_rules.sizes(asked, tables.cells(_nation_tables(t), "n_regionkey", "markup"), "n_regionkey")


@query("""select n_nationkey, 'sql' as language, 'select ' || n_nationkey || chr(10) as code, 'x_' || n_nationkey || '=1' as formula, n_name as marked, true as footer, n_nationkey % 2 = 0 as repeats from nation""")
def markup_rules(t):
    k = F.col("n_nationkey").cast("string")
    line = F.when(F.col("n_nationkey") % 2 == 0, F.repeat(F.lit("a line that a generator repeats\n"), 9)).otherwise("\n")
    doc = F.concat(F.lit("text\n```sql\nselect "), k, F.lit("\n```\nso $$x_"), k, F.lit(" = 1$$ and <mark style=\"background:red\">"), F.col("n_name"), F.lit("</mark>\n"), line, F.lit("<footer><b>page "), k, F.lit("</b></footer>"))
    d = t("nation").select("n_nationkey", "n_name", doc.alias("d"))
    code = rules.code_blocks(F.col("d"))[0]
    return d.select("n_nationkey", code["language"].alias("language"), code["code"].alias("code"), rules.formulas(F.col("d"))[0].alias("formula"), rules.marked(F.col("d"), "red")[0].alias("marked"),
                    rules.in_section(F.col("d"), "footer", F.concat(F.lit("page "), F.col("n_nationkey").cast("string"))).alias("footer"), rules.repeats(F.col("d")).alias("repeats"))


# --- streams ---------------------------------------------------------------------------------------------------------------------


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: counts and means by type and hour, once all files are read."""
    path = f"{sf_dir}/events.parquet"  # a pattern below: the path may be one file
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = score_stream.settled(score_stream.windows_of(stream, "ts", "event_type", "value", width="1 hour"), spark)
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n", F.round("average", 6).alias("average"))


QUERIES["stream_windows"] = stream_windows
ORACLES["stream_windows"] = "select event_type, strftime(ts, '%Y-%m-%d %H') as hour, count(*) n, round(avg(value), 6) average from events group by 1, 2"
