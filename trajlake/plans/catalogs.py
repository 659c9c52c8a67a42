"""Catalogue joins, reports of what is missing, manifests and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake import ledger, sinks
from trajlake.functions.keyed import draw, draw_sql
from trajlake.operators import batches, lookups, negatives, ranking
from trajlake.operators.lineage import scratch
from trajlake.plans.registry import query
from trajlake.sources import table


def _modalities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    """Orders, and what each needs: lines, a customer of the first 20 nations, a price."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), "o_orderstatus", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")).where("key is not null").distinct()
    customers = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("cust"))
    known = orders.join(customers, "cust", "left_semi").select("key")
    priced = orders.where("o_totalprice > 1000").select("key")
    return orders.select("key", "o_orderstatus"), [lines, known, priced]


_HAS = """lines as (select distinct l_orderkey as key from lineitem), known as (select o_orderkey as key from orders where o_custkey in (select c_custkey from customer where c_nationkey < 20)),
priced as (select o_orderkey as key from orders where o_totalprice > 1000)"""


@query(f"with {_HAS} select o_orderkey as key, o_orderstatus from orders where o_orderkey in (select key from lines) and o_orderkey in (select key from known)")
def catalog_join3(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, need = _modalities(spark, sf_dir)
    return lookups.having_all(orders, need[:2], ["key"])


@query(f"with {_HAS} select o_orderkey as key, o_orderstatus from orders where o_orderkey in (select key from lines intersect select key from known intersect select key from priced)")
def catalog_join4(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, need = _modalities(spark, sf_dir)
    return lookups.having_all(orders, need, ["key"])


@query(f"with {_HAS} " + " union all ".join(f"select o_orderkey as key, '{r}' as reason from orders where o_orderkey not in (select key from {r})" for r in ("lines", "known", "priced")))
def catalog_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, need = _modalities(spark, sf_dir)
    return lookups.missing(orders, dict(zip(("lines", "known", "priced"), need)), ["key"])


@query("""select d.doc_id, coalesce(case when l.quality = 1 then 'labelled' end, b.text, case when trim(d.lang) <> '' then d.lang end) as resource
from documents d left join labels l on l.doc_id = d.doc_id left join benchmark b on b.item_id = d.doc_id""")
def catalog_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit("labelled")).alias("own"))
    shared = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("by_id"))
    joined = docs.join(labels, "doc_id", "left").join(shared, "doc_id", "left")
    return joined.select("doc_id", lookups.first_of(F.col("own"), F.col("by_id"), F.col("lang")).alias("resource"))


@query("""with e as (select case when user_id % 3 = 0 then 'randomized' else 'clean' end as split, event_type as task, user_id from events where not (user_id % 3 = 0 and event_type = 'error')),
c as (select split, task, count(distinct user_id) as episodes from e group by 1, 2)
select s.split, t.task, coalesce(c.episodes, 0) as episodes, 1.0::double / count(*) over (partition by s.split) as weight, sum(c.episodes) over ()::bigint as total
from (select distinct split from e) s cross join (select distinct task from e) t left join c on c.split = s.split and c.task = t.task""")
def task_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every split with every task, whether or not it has episodes: how many, the weight all tasks share alike, and all episodes."""
    split = F.when(F.col("user_id") % 3 == 0, "randomized").otherwise("clean")
    rows = table(spark, sf_dir, "events").select(split.alias("split"), F.col("event_type").alias("task"), "user_id").where("split = 'clean' or task <> 'error'")
    counts = rows.groupBy("split", "task").agg(F.count_distinct("user_id").alias("episodes"))
    splits, tasks = counts.select("split").distinct(), counts.select("task").distinct()
    every = splits.crossJoin(tasks).join(counts, ["split", "task"], "left")  # one row for each split and task
    totals = counts.agg(F.count_distinct("task").alias("tasks"), F.sum("episodes").alias("total"))  # one row
    return every.crossJoin(F.broadcast(totals)).select("split", "task", F.coalesce("episodes", F.lit(0)).alias("episodes"), (F.lit(1.0) / F.col("tasks")).alias("weight"), "total")


_UNION = """select doc_id, label from ((select doc_id, 1 as label from labels where quality = 1 order by doc_id limit 200)
union all (select doc_id, 0 as label from documents where n_chars < 1000 order by doc_id limit 200))"""


@query(_UNION)
def manifest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and negatives, each limited first (the limit of each side is what the operator is for)."""
    good = table(spark, sf_dir, "labels").where("quality = 1").orderBy("doc_id").limit(200).select("doc_id", F.lit(1).alias("label"))
    short = table(spark, sf_dir, "documents").where("n_chars < 1000").orderBy("doc_id").limit(200).select("doc_id", F.lit(0).alias("label"))
    return good.unionByName(short)


@query("""select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is not null then l.k else d.k end as k
from (select doc_id, (n_chars % 7)::int as k from documents) d full join (select doc_id, quality + 10 as k from labels union all select page_id + 10000000000, 99 from pages) l on l.doc_id = d.doc_id""")
def dedup_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert: labels over a column of documents, and pages as rows with new keys."""
    old = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 7).cast("int").alias("k"))
    new = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 10).alias("k"))
    return lookups.upsert(old, new.unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 10_000_000_000).alias("doc_id"), F.lit(99).alias("k"))), ["doc_id"])


@query("""select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is not null then l.k else d.k end as k
from (select doc_id, (n_chars % 7)::int as k from documents) d full join (select doc_id, quality + 10 as k from labels where quality = 0 union all select page_id + 10000000000, 99 from pages) l on l.doc_id = d.doc_id""")
def upsert_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set in ranges of a hundred documents; bad labels and new rows are merged into the ranges they touch."""
    path, part = scratch(spark, "ranges"), F.floor(F.col("doc_id") / 100)
    sinks.write_ranges(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 7).cast("int").alias("k")), ["doc_id"], path, part)
    new = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", (F.col("quality") + 10).alias("k"))
    new = new.unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 10_000_000_000).alias("doc_id"), F.lit(99).alias("k")))
    sinks.upsert_ranges(new, ["doc_id"], path, part)
    return spark.read.parquet(path).select("doc_id", "k")


@query("select user_id, min(event_id) as event_id, count(*) > 0 as cached from events group by user_id")
def cache_put_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of one row for each user, filled for those who buy, and then for all."""
    path = scratch(spark, "cache")
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.bool_or(F.col("event_type") == "purchase").alias("buys"))
    for some in (first.where("buys"), first):
        ledger.put_absent(some.drop("buys"), ["user_id"], path, lambda rows: rows.withColumn("cached", F.lit(True)))
    return ledger.published(spark, path)


@query("""select doc_id, quality, coalesce(case when trim(d.source) <> '' then d.source end, d.lang) as origin from documents d left join labels l using (doc_id)
where text is not null and length(text) >= 64 and coalesce(quality, 1) = 1""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    some = docs.where("text is not null and length(text) >= 64").select("doc_id", lookups.first_of(F.col("source"), F.col("lang")).alias("origin"))
    return some.join(labels, "doc_id", "left").where("coalesce(quality, 1) = 1").select("doc_id", "quality", "origin")


@query("""with n as (select l_orderkey as key, count(*) as lines, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by 1)
select key, lines, parts, suppliers, len(list_distinct([lines, parts, suppliers])) = 1 as agree from n""")
def count_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.operators.statistics import agreement

    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"))
    counts = lines.agg(F.count("*").alias("lines"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))
    return counts.withColumn("agree", agreement([F.col("lines"), F.col("parts"), F.col("suppliers")]))


@query("select doc_id, (row_number() over (order by doc_id) - 1) % 8 as shard from documents")
def shard_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.operators.batches import strided

    placed = ranking.positions(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"))
    return placed.select("doc_id", strided(F.col("rn"), 8).alias("shard"))


@query("select doc_id, (row_number() over (order by doc_id) - 1) // ceil(count(*) over () / 7.0)::bigint as shard from documents")
def shard_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.operators.batches import contiguous

    docs = table(spark, sf_dir, "documents").select("doc_id")
    placed = ranking.positions(docs, F.col("doc_id")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))  # one row
    return placed.select("doc_id", contiguous(F.col("rn"), F.col("n"), 7).alias("shard"))


@query(f"select doc_id, row_number() over (order by {draw_sql(3, 'doc_id')}, doc_id) - 1 as place from documents")
def hashed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible shuffle of a whole table."""
    return ranking.positions(table(spark, sf_dir, "documents").select("doc_id"), draw(3, F.col("doc_id")), "doc_id", name="place")


_EPISODES = """(select 'clean' as split, c_nationkey::varchar as task, c_custkey::varchar as episode from customer union all select 'randomized', s_nationkey::varchar, s_suppkey::varchar from supplier)"""


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as the episodes of two splits, nations as their tasks; all names are text."""
    parts = [table(spark, sf_dir, t).select(F.lit(split).alias("split"), F.col(f"{p}_nationkey").cast("string").alias("task"), F.col(f"{p}_{k}key").cast("string").alias("episode")) for split, t, p, k in (("clean", "customer", "c", "cust"), ("randomized", "supplier", "s", "supp"))]
    return parts[0].unionByName(parts[1])


@query(f"select split, task, episode, row_number() over (order by split, task, episode) - 1 as place from {_EPISODES}")
def episode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes in the order of three names, as text: 10 comes before 2."""
    return ranking.ordered_positions(_splits(spark, sf_dir), "split", "task", "episode", name="place")


@query(f"""select task, count(*) as episodes, count(*) filter (split = 'clean') as clean, count(distinct split) as splits, min(split || '/' || episode) as first, max(split || '/' || episode) as final from {_EPISODES} group by task""")
def merged_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits side by side: a task of both is one bucket."""
    name = F.concat_ws("/", "split", "episode")
    return _splits(spark, sf_dir).groupBy("task").agg(F.count("*").alias("episodes"), F.count_if(F.col("split") == "clean").alias("clean"), F.count_distinct("split").alias("splits"), F.min(name).alias("first"), F.max(name).alias("final"))


@query(f"""with e as {_EPISODES}, f as (select 't' || s_nationkey::varchar || '/instructions/' || s_suppkey::varchar || '.json' as path from supplier where s_acctbal > 5000
union all select 't' || s_nationkey::varchar || '/' || s_suppkey::varchar || '.json' from supplier where s_acctbal > 0 union all select 'instructions/' || c_custkey::varchar || '.json' from customer where c_mktsegment = 'BUILDING'),
c as (select *, unnest([0, 1, 2]) as prio, unnest(['t' || task || '/instructions/' || episode || '.json', 't' || task || '/' || episode || '.json', 'instructions/' || episode || '.json']) as path from e),
h as (select split, task, episode, arg_min(path, prio) as found from c where path in (select path from f) group by all)
select e.split, e.task, e.episode, h.found, o.n as length from e left join h using (split, task, episode) left join (select o_custkey::varchar as episode, count(*) as n from orders group by 1) o on o.episode = e.episode""")
def instruction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three places where an episode's instructions may be, the first that has a file, and its length, where one is known."""
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    task, own = F.concat(F.lit("t"), "s_nationkey"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".json"))
    files = supplier.where("s_acctbal > 5000").select(F.concat(task, F.lit("/instructions/"), own).alias("path")).unionByName(supplier.where("s_acctbal > 0").select(F.concat(task, F.lit("/"), own).alias("path")))
    files = files.unionByName(customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("instructions/"), "c_custkey", F.lit(".json")).alias("path")))
    name = F.concat("episode", F.lit(".json"))
    places = [F.concat(F.lit("t"), "task", F.lit("/instructions/"), name), F.concat(F.lit("t"), "task", F.lit("/"), name), F.concat(F.lit("instructions/"), name)]
    found = lookups.first_path(_splits(spark, sf_dir), ["split", "task", "episode"], places, files)
    lengths = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("episode")).agg(F.count("*").alias("length"))
    return lookups.with_length(found, lengths, "episode", "length")


@query("""with r as (select doc_id // 4 as batch_id, doc_id, quality from documents left join labels using (doc_id))
select batch_id, doc_id, quality from r where quality is not null union all select batch_id, null, null from r group by 1 having count(quality) = 0""")
def batches_without_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that are there; a batch that has none is empty, which is a row too."""
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).alias("batch_id"), "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return batches.without_null(rows.select("batch_id", "doc_id", "quality"), "batch_id", "quality")


@query("""select vec_id, len(free) as n, list_sum(list_transform(free, lambda d, i: d * i))::bigint as placed
from (select vec_id, list_filter(range(len(embedding)), lambda d: d <> 6 and d <> 13 and d <> label and d <> vec_id % 64) as free from embeddings)""")
def free_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions but for two that are fixed and two of each row's own."""
    avoid = F.array(F.lit(6), F.lit(13), F.col("label").cast("int"), (F.col("vec_id") % 64).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", negatives.free_dims_of(F.size("embedding"), avoid).alias("free"))
    placed = F.aggregate(F.transform("free", lambda d, i: (d * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("vec_id", F.size("free").cast("long").alias("n"), placed.alias("placed"))
