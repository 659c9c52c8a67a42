"""Scans with and without tolerance, checks, resources, statistics documents, collated batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake import sinks
from trajlake.functions import chat
from trajlake.functions import text as tx
from trajlake.functions.keyed import draw, draw_sql
from trajlake.functions.vectors import block, clip, normalise, rounded, squeeze, to_two_dimensions
from trajlake.operators import batches, hooks, lookups, records, windows
from trajlake.operators.lineage import scratch
from trajlake.plans.registry import query
from trajlake.plans.samples import _CELLS, _matrices
from trajlake.plans.statistics import VALUES
from trajlake.plans.texts import _LINES
from trajlake.plans.trajectories import FRAMES, LENGTHS, _sources
from trajlake.sources import episode_frames, episode_lengths, located_manifest, read_entries, table, with_entry

#: Payloads of several kinds, as files of different sorts hold them.
_PAYLOAD = "case when event_id % 7 = 0 then null when event_id % 7 = 1 then ' ' when event_id % 7 = 2 then '[' || value::varchar || ']' when event_id % 7 = 3 then 'x' || event_id::varchar else (event_id % 100)::varchar end"
_PROBLEM = f"case when ({_PAYLOAD}) is null then 'missing' when trim({_PAYLOAD}) = '' then 'empty' when starts_with(ltrim({_PAYLOAD}), '[') then 'list' when try_cast(trim({_PAYLOAD}) as double) is null then 'not a number' end"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, key = F.col("event_id") % 7, F.col("event_id").cast("string")
    held = F.when(kind == 0, None).when(kind == 1, " ").when(kind == 2, F.concat(F.lit("["), F.col("value").cast("string"), F.lit("]"))).when(kind == 3, F.concat(F.lit("x"), key)).otherwise((F.col("event_id") % 100).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", held.alias("payload"))


@query(f"select event_id, ({_PROBLEM}) is null as ok, case when ({_PROBLEM}) is null then try_cast(trim({_PAYLOAD}) as double) end as value, {_PROBLEM} as err from events")
def scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading of each record with whether it went well, and if not, why."""
    payload = F.col("payload")
    return _payloads(spark, sf_dir).select("event_id", *records.status(tx.strip(payload).try_cast("double"), records.number_problem(payload)))


@query(f"select event_id, try_cast(trim({_PAYLOAD}) as double) as value from events where ({_PROBLEM}) is null")
def scan_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read; the rest is left out."""
    payload = F.col("payload")
    return _payloads(spark, sf_dir).where(records.number_problem(payload).isNull()).select("event_id", tx.strip(payload).try_cast("double").alias("value"))


@query("select event_id, (json_extract_string(props, '$.k'))::double as value from events")
def scan_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cannot be read would fail the query."""
    held = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", records.strictly(held.try_cast("double"), records.number_problem(held), F.col("event_id")).alias("value"))


@query(f"select event_type, count(*) as scanned, count(*) filter (where ({_PROBLEM}) is null) as succeeded, count(*) filter (where ({_PROBLEM}) is not null) as failed from events group by event_type")
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payloads(spark, sf_dir).withColumn("ok", records.number_problem(F.col("payload")).isNull())
    return records.counted(rows, "event_type")


@query("""with v as (select l_orderkey as key, count(*) filter (where l_linenumber % 2 = 1) as high, sum(l_quantity) as seconds, count(*) as left_, count(distinct l_suppkey) as right_ from lineitem group by 1),
e as (select key, case when key % 3 = 0 then 0 when key % 3 = 1 then key % 50 end as given, case when high > 0 then high when floor(seconds * 0.5) > 0 then floor(seconds * 0.5)::bigint end as a,
case when key % 5 > 0 then left_ when floor(seconds * 0.1) > 0 then floor(seconds * 0.1)::bigint end as b, case when right_ > 0 then right_ end as c from v)
select key, case when given > 0 then given when a is not null and b is not null and c is not null then least(a, b, c) end as frames from e""")
def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of an order: as given, or else the least over three ways to count its lines."""
    key = F.col("key")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"))
    views = lines.agg(F.count_if(F.col("l_linenumber") % 2 == 1).alias("high"), F.sum("l_quantity").alias("seconds"), F.count("*").alias("left"), F.count_distinct("l_suppkey").alias("right"))
    given = F.when(key % 3 == 0, F.lit(0)).when(key % 3 == 1, key % 50)
    ways = [(F.col("high"), F.col("seconds"), F.lit(0.5)), (F.when(key % 5 > 0, F.col("left")), F.col("seconds"), F.lit(0.1)), (F.col("right"), F.lit(0.0), F.lit(1.0))]
    return views.select("key", records.frame_count(given, ways).alias("frames"))


@query(f"""with s as (select user_id, n, least(n, 64) as actions, n // 4 as frames, 120 * (3 + n % 3) as tokens from {LENGTHS})
select user_id, concat_ws(',', case when frames < 16 then 'frames' end, case when actions < 64 then 'actions' end, case when tokens <> 600 then 'tokens' end) as broken,
frames >= 16 and actions >= 64 and tokens = 600 as ok from s""")
def shape_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shapes of an episode's sample are not as they should be: 16 frames and 64 actions at least, five token blocks."""
    n = F.col("n")
    broken = records.problems(frames=F.floor(n / 4) >= 16, actions=F.least(n, F.lit(64)) >= 64, tokens=120 * (3 + n % 3) == 600)
    rows = episode_lengths(table(spark, sf_dir, "events")).select("user_id", broken.alias("broken"))
    return rows.select("user_id", F.array_join("broken", ",").alias("broken"), (F.size("broken") == 0).alias("ok"))


@query(f"""with p as (select vec_id, label, len(embedding) as size, list_min(embedding)::double as low, list_max(embedding)::double as high from embeddings)
select label, count(*) as n, min(size) as size_low, max(size) as size_high, min(low) as low, max(high) as high, count(*) filter (where size <> 64 or high > 0.45 or low < -0.45) as odd from p group by label""")
def inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of samples by task: sizes, ranges, and how many break a rule."""
    low, high, size = (f("embedding") for f in (F.array_min, F.array_max, F.size))
    broken = records.problems(size=size == 64, high=high.cast("double") <= 0.45, low=low.cast("double") >= -0.45)
    rows = table(spark, sf_dir, "embeddings").select("label", size.cast("long").alias("size"), low.cast("double").alias("low"), high.cast("double").alias("high"), (F.size(broken) > 0).alias("odd"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.min("size").alias("size_low"), F.max("size").alias("size_high"), F.min("low").alias("low"), F.max("high").alias("high"), F.count_if("odd").alias("odd"))


@query("select vec_id, list_sum(list_transform(embedding, lambda x: round(x::double, 3))) is not null as whole, len(embedding) as n, embedding[1]::double as first from embeddings")
def squeezed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of one sample without its batch dimension; a batch of several would fail."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", squeeze(F.array("embedding")).alias("x"))
    flat = to_two_dimensions(1, F.col("x"))
    return rows.select("vec_id", (F.size(F.filter("x", lambda v: v.isNotNull())) == F.size("x")).alias("whole"), F.size(F.get(flat, F.lit(0))).cast("long").alias("n"), F.get("x", F.lit(0)).cast("double").alias("first"))


@query("""select doc_id, case when doc_id % 3 <> 0 then case when doc_id % 5 = 0 then null else lang end else source end as origin, n_chars from documents""")
def field_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample's field, or the manifest's where the sample has none; a field that is there and null stays null."""
    held = F.map_filter(F.create_map(F.lit("lang"), F.when(F.col("doc_id") % 5 != 0, F.col("lang"))), lambda k, v: F.col("doc_id") % 3 != 0)
    return table(spark, sf_dir, "documents").select("doc_id", lookups.field_or(held, "lang", F.col("source")).alias("origin"), "n_chars")


_RESOURCES = """pts as (select s_nationkey::varchar as task, s_suppkey::varchar as name from supplier where s_nationkey <> 5 union select n_nationkey::varchar, n_nationkey::varchar from nation where n_nationkey % 2 = 0 union select '5', 'only'),
txts as (select c_nationkey::varchar as task, c_custkey::varchar as name from customer where c_acctbal > 0 and c_nationkey <> 5 union select n_nationkey::varchar, n_nationkey::varchar from nation where n_nationkey % 3 = 0 union select '5', 'only'),
e as (select c_custkey, c_nationkey::varchar as task, c_custkey::varchar as episode from customer)"""


@query(f"""with {_RESOURCES}, k as (select task, count(*) as pt, any_value(name) as only_pt from pts group by 1), l as (select task, count(*) as txt, any_value(name) as only_txt from txts group by 1),
r as (select e.c_custkey, e.task, case when pt = 1 and txt = 1 then only_pt else coalesce(a.name, b.name) end as embedding, case when pt = 1 and txt = 1 then only_txt else coalesce(c.name, d.name) end as text
from e left join k using (task) left join l using (task) left join pts a on a.task = e.task and a.name = e.episode left join pts b on b.task = e.task and b.name = e.task
left join txts c on c.task = e.task and c.name = e.episode left join txts d on d.task = e.task and d.name = e.task)
select * from r where embedding is not null and text is not null""")
def language_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as episodes of nations: resources shared by a task that has one pair, else by name, else by the task's name."""
    nations, one = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("task"), "n_nationkey"), spark.range(1).select(F.lit("5").alias("task"), F.lit("only").alias("name"))
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")

    def files(own: DataFrame, every: int) -> DataFrame:
        shared = nations.where(F.col("n_nationkey") % every == 0).select("task", F.col("task").alias("name"))
        return own.where("task <> '5'").unionByName(shared).unionByName(one).distinct().withColumn("path", F.col("name"))

    pts = files(supplier.select(F.col("s_nationkey").cast("string").alias("task"), F.col("s_suppkey").cast("string").alias("name")), 2)
    txts = files(customer.where("c_acctbal > 0").select(F.col("c_nationkey").cast("string").alias("task"), F.col("c_custkey").cast("string").alias("name")), 3)
    episodes = customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("task"), F.col("c_custkey").cast("string").alias("episode"))
    return lookups.resolve_resources(episodes, pts, txts, "task", "episode").drop("episode")


@query(f"""with r as (select label, dim, min(x) as low, max(x) as high from {VALUES} group by 1, 2)
select v.vec_id, v.dim, round((v.x - r.low) / case when r.high = r.low then 1 else r.high - r.low end, 6) as y from {VALUES} v join r on r.label = v.label and r.dim = v.dim""")
def stats_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by task, written as one JSON document and read again; each vector is normalised by its task's entry."""
    path = scratch(spark, "statistics")
    values = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))

    def ordered(c: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("dim", c))), lambda z: z[c]).alias(c)

    sinks.write_document(values.groupBy("label").agg(ordered("low"), ordered("high")), "label", path)
    entries = read_entries(spark, path, "low array<double>, high array<double>")
    rows = with_entry(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), F.col("label").cast("string"), entries, ["low", "high"])
    zipped = rows.select("vec_id", F.posexplode(F.arrays_zip(F.col("embedding").alias("x"), "low", "high")).alias("dim", "z"))
    return zipped.select("vec_id", F.col("dim").cast("long").alias("dim"), rounded(normalise(F.col("z.x").cast("double"), F.col("z.low"), F.col("z.high"))).alias("y"))


@query("""with p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages),
q as (select page_id, path, regexp_matches(path, '^(.*/)?[^/]+/[^/]+/[^/]+/[^/]+$') as fits, 'root/' || path as full from p)
select page_id, 'data/' || path as below, regexp_replace(path, '([^/])\\.[^./]*$', '\\1') || '.pt' as renamed,
'tasks/' || (case when page_id % 2 = 0 then 'clean' else 'randomized' end) || '/t' || (page_id % 9)::varchar || '/videos/' || page_id::varchar || '.mp4' as moved from q""")
def path_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below a root, with another extension, and in another layout."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    old = F.concat(F.lit("tasks/t"), (F.col("page_id") % 9).cast("string"), F.when(F.col("page_id") % 2 == 0, "/aloha_clean/videos/").otherwise("/aloha_rand/videos/"), F.col("page_id").cast("string"), F.lit(".mp4"))
    below = tx.relative(F.concat(F.lit("/root/data/"), path), F.lit("/root/"))
    return table(spark, sf_dir, "pages").select("page_id", below.alias("below"), tx.with_extension(path, ".pt").alias("renamed"), tx.moved(old).alias("moved"))


_WORDS = "string_split(text, ' ')"


@query(f"""with e as (select conv_id, turn, unnest(range(len({_WORDS}))) as pos, unnest({_WORDS}) as w from conversations where role <> 'system'),
k as (select conv_id, turn, pos, w, case length(w) % 5 when 0 then 'image' when 1 then 'image' when 2 then 'video' end as kind from e)
select conv_id, turn, kind, count(*) as n, md5(string_agg(w, ',' order by pos)) as sources from k where kind is not null and length(w) % 7 > 0 group by 1, 2, 3""")
def chat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images and videos that messages name.  Contents are JSON: plain text of the system, and lists of elements of others, of which
    some have the key of a medium and some an address and a type."""
    word, size = F.col("w"), F.length("w")
    element = F.when(size % 7 == 0, F.to_json(F.struct(F.lit("text").alias("type"), word.alias("text"))))
    element = element.when(size % 5 == 0, F.to_json(F.struct(F.lit("image").alias("type"), word.alias("image"))))
    element = element.when(size % 5 == 1, F.to_json(F.struct(F.lit("image_url").alias("type"), word.alias("image_url"))))
    element = element.when(size % 5 == 2, F.to_json(F.struct(word.alias("video"), F.lit(2).alias("fps")))).otherwise(F.to_json(F.struct(F.lit("text").alias("type"), word.alias("text"))))
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    held = words.withColumn("e", element).groupBy("conv_id", "turn", "role", "text").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("es"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]"))
    messages = held.select("conv_id", "turn", F.when(F.col("role") == "system", F.col("text")).otherwise(listed).alias("content"))
    found = messages.select("conv_id", "turn", F.posexplode(chat.media(F.col("content"))).alias("pos", "m")).select("conv_id", "turn", "pos", "m.kind", "m.source")
    sources = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]), ",")
    return found.groupBy("conv_id", "turn", "kind").agg(F.count("*").alias("n"), F.md5(sources.cast("binary")).alias("sources"))


@query("""with t as (select doc_id, list_transform(list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> ''), lambda w: length(w)::bigint) as ids from documents),
b as (select doc_id, ids, (list_sum(ids) % 4)::bigint as k from t where len(ids) >= 600)
select doc_id, k, list_sum(list_transform(ids[120 * k + 1:120 * k + 120], lambda x, i: x * i))::bigint as now, list_sum(list_transform(ids[120 * (k + 1) + 1:120 * (k + 1) + 120], lambda x, i: x * i))::bigint as next from b""")
def token_blocks_120(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of six hundred token rows the block of a time slice and the one after it, of 120 rows each."""
    ids = F.transform(F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != ""), lambda w: F.length(w).cast("long"))
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).where(F.size("ids") >= 600)
    rows = rows.withColumn("k", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x) % 4)
    total = lambda k: F.aggregate(F.transform(block(F.transform("ids", lambda x: x.cast("double")), k), lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "k", total(F.col("k")).alias("now"), total(F.col("k") + 1).alias("next"))


@query("""with j as (select doc_id, '{"label":' || quality::varchar || ',"path":"docs/' || doc_id::varchar || '"}' as line from labels)
select 'docs/' || doc_id::varchar as path, quality::bigint as label, row_number() over (order by doc_id) - 1 as number from labels""")
def manifest_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest in several files, read with each entry's number over all of them."""
    path = scratch(spark, "manifest")
    lines = table(spark, sf_dir, "labels").select("doc_id", F.to_json(F.struct(F.col("quality").alias("label"), F.concat(F.lit("docs/"), F.col("doc_id")).alias("path"))).alias("value"))
    lines.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return located_manifest(spark, path).select("path", "label", "number")


@query("""select vec_id, case when len(embedding) = 64 and label % 3 > 0 then round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) end as norm, label % 3 > 0 as ok,
case when label % 3 = 0 then 'ValueError: label ' || label::varchar end as err from embeddings""")
def hooked_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User code on batches; rows that it cannot take say why, and the others of their batch are whole."""

    def set_up():
        import numpy as np

        def encode(batch):
            labels = batch.column("label").to_pylist()
            for label in labels:
                if label % 3 == 0:
                    raise ValueError(f"label {label}")
            x = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
            return {"norm": (x * x).sum(axis=1)}

        return encode

    rows = hooks.hooked(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), set_up, "norm double", rows_per_call=4)
    return rows.select("vec_id", rounded(F.col("norm")).alias("norm"), "ok", "err")


@query("""with d as (select d.doc_id, d.doc_id // 4 as batch_id, l.quality, case when d.n_chars > 60 then d.n_chars end as size from documents d left join labels l using (doc_id))
select doc_id, batch_id, case when bool_and(quality is not null) over (partition by batch_id) then quality end as quality, case when bool_and(size is not null) over (partition by batch_id) then size end as size from d""")
def collate_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional fields only in batches all of whose rows have them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("batch_id"), F.when(F.col("n_chars") > 60, F.col("n_chars")).alias("size"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return batches.optional(rows, "batch_id", ["quality", "size"]).select("doc_id", "batch_id", "quality", "size")


_KEPT = "list_filter(embedding, lambda x: x > 0)"


@query(f"""with e as (select vec_id, vec_id // 16 as batch_id, label, embedding[1]::double as frame, {_KEPT} as tokens, case when vec_id // 16 % 2 = 0 or vec_id % 3 > 0 then list_transform({_KEPT}, lambda x: x > 0.1) end as seen,
list_sum(list_transform(embedding[17:32], lambda x: x::double)) as actions, list_sum(list_transform(embedding[33:48], lambda x: x::double)) as block, list_sum(list_transform(embedding[49:64], lambda x: x::double)) as future from embeddings),
b as (select *, max(len(tokens)) over (partition by batch_id) as longest, bool_and(seen is not null) over (partition by batch_id) as all_seen from e)
select vec_id, batch_id, label, frame, round(actions, 6) as actions, round(block, 6) as block, round(future, 6) as future, longest, len(tokens) as valid, round(coalesce(list_sum(list_transform(tokens, lambda x: x::double)), 0), 6) as total,
case when all_seen then len(list_filter(seen, lambda x: x)) end as seen from b""")
def collate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stacked fields, tokens padded to the longest of the batch, and their mask where all rows of the batch have it."""
    kept = F.filter("embedding", lambda x: x > 0)
    part = lambda a: F.transform(F.slice("embedding", a, 16), lambda x: x.cast("double"))
    mask = F.when((F.floor(F.col("vec_id") / 16) % 2 == 0) | (F.col("vec_id") % 3 > 0), F.transform(kept, lambda x: x.cast("double") > 0.1))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 16).alias("batch_id"), "label", F.get("embedding", F.lit(0)).cast("double").alias("frame"), part(17).alias("actions"), part(33).alias("block"), part(49).alias("future"), kept.alias("tokens"), mask.alias("seen"))
    out = batches.collate_fields(rows, "batch_id", "tokens", "seen", "vec_id", "label", "frame", "actions", "block", "future")
    total = lambda c: rounded(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")))
    true = lambda c: F.size(F.filter(c, lambda x: x)).cast("long")
    return out.select("vec_id", "batch_id", "label", "frame", *(total(c).alias(c) for c in ("actions", "block", "future")), F.size("tokens").cast("long").alias("longest"), true("valid").alias("valid"), total("tokens").alias("total"), F.when(F.col("seen").isNotNull(), true("seen")).alias("seen"))


_SLICED = f"""src as (select user_id, n, unnest(range(0, n, 64)) as c from {LENGTHS} where n >= 2), own as (select *, unnest([15, 31, 47])::bigint as s from src),
idx as (select user_id, c, s, k as pos, least(c + 1 + s + k, n - 1) as idx, n from own, (select unnest(range(17)) as k)),
whole as (select user_id, c, s from idx group by 1, 2, 3 having count(distinct idx) = 17)"""


@query(f"""with {_SLICED}, k as (select user_id, c, s, greatest(1, least(4, 1 + ((s + 1) // 4 - 4) // 4)) as now from whole)
select i.user_id, i.c, i.s, 'action' as kind, i.pos, f.value as x from idx i join whole using (user_id, c, s) join {FRAMES} f on f.user_id = i.user_id and f.frame_idx = i.idx
union all select k.user_id, k.c, k.s, 'frame', 0, f.value from k join src on src.user_id = k.user_id and src.c = k.c join {FRAMES} f on f.user_id = k.user_id and f.frame_idx = least(k.c + k.s + 1, src.n - 1)
union all select k.user_id, k.c, k.s, 'block', p, e.embedding[k.now * 12 + p + 1]::double from k join embeddings e on e.vec_id = k.user_id, (select unnest(range(12)) as p)
union all select k.user_id, k.c, k.s, 'future', p, e.embedding[least(k.now + 1, 4) * 12 + p + 1]::double from k join embeddings e on e.vec_id = k.user_id, (select unnest(range(12)) as p)""")
def slice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a slice of a source holds: 17 actions, the frame where it starts, and the rows of its own and the next token block.  Sources are
    stretches of episodes; their tokens are five blocks of twelve values of the vector of the same number."""
    events = table(spark, sf_dir, "events")
    found = windows.source_slices(_sources(episode_lengths(events, 2)), "idx").withColumn("s", F.col("s").cast("long"))
    asked = found.select("user_id", "c", "s", F.posexplode("own").alias("pos", "action_idx"))
    frame = found.select("user_id", "c", "s", F.lit(0).alias("pos"), F.get("idx", F.col("s").cast("int")).alias("action_idx"))
    indexed = asked.withColumn("kind", F.lit("action")).unionByName(frame.withColumn("kind", F.lit("frame")))
    values = lookups.gather_strict(indexed, episode_frames(events), "action_idx", ["value"]).select("user_id", "c", "s", "kind", "pos", F.col("value").alias("x"))
    tokens = found.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user_id"), "embedding"), "user_id")

    def block(kind: str, k: str) -> DataFrame:
        rows = F.transform(F.slice("embedding", (F.col(k) * 12 + 1).cast("int"), F.lit(12)), lambda x: x.cast("double"))
        return tokens.select("user_id", "c", "s", F.lit(kind).alias("kind"), F.posexplode(rows).alias("pos", "x"))

    return values.unionByName(block("block", "token_now")).unionByName(block("future", "token_next")).withColumn("pos", F.col("pos").cast("long"))


@query(f"select w.user_id, w.frame_idx, f.value from (select user_id, unnest(range(least(n, 5))) as frame_idx from {LENGTHS}) w join {FRAMES} f using (user_id, frame_idx)")
def gather_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gather that would fail on an index outside its episode."""
    events = table(spark, sf_dir, "events")
    asked = episode_lengths(events).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(5)) - 1)).alias("at"))
    return lookups.gather_strict(asked, episode_frames(events), "at", ["value"]).select("user_id", F.col("at").alias("frame_idx"), "value")


@query(f"""with l as (select user_id, n, {draw_sql(7, "'condition'", "user_id")} % 200 as c from {LENGTHS}) select user_id, c, least(c, n - 1) as condition, f.value from l join {FRAMES} f using (user_id) where f.frame_idx = least(c, n - 1)""")
def condition_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition index, held within its episode, and the frame there."""
    events = table(spark, sf_dir, "events")
    c = draw(7, "condition", F.col("user_id")) % 200
    asked = episode_lengths(events).select("user_id", c.alias("c"), F.least(c, F.col("n") - 1).alias("condition"))
    return lookups.gather(asked, episode_frames(events), "condition", ["value"]).select("user_id", "c", "condition", "value")


@query(f"select vec_id, d, min(x) as low, max(x) as high from {_CELLS} group by vec_id, d")
def file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest of each file's dimensions over its steps, without exploding the steps."""
    columns = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: F.transform("actions", lambda row: F.get(row, d)))
    rows = _matrices(spark, sf_dir).select("vec_id", F.posexplode(columns).alias("d", "x"))
    return rows.select("vec_id", F.col("d").cast("long").alias("d"), F.array_min("x").alias("low"), F.array_max("x").alias("high"))


@query(f"""with r as (select label, dim, min(x) as low, max(x) as high, avg(x) as mean from {VALUES} group by 1, 2)
select label, count(*) as dims, count(*) filter (where high - low > 0.5) as wide, round(avg(high - low), 6) as mean_range, round(min(high - low), 6) as least_range, round(max(high - low), 6) as most_range, count(*) filter (where abs(mean) < 0.01) as centred from r group by label""")
def dimension_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the statistics of each dimension."""
    values = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).select("label", "dim", F.col("v").cast("double").alias("x"))
    each = values.groupBy("label", "dim").agg((F.max("x") - F.min("x")).alias("range"), F.avg("x").alias("mean"))
    return each.groupBy("label").agg(F.count("*").alias("dims"), F.count_if(F.col("range") > 0.5).alias("wide"), rounded(F.avg("range")).alias("mean_range"), rounded(F.min("range")).alias("least_range"), rounded(F.max("range")).alias("most_range"), F.count_if(F.abs("mean") < 0.01).alias("centred"))


@query("select source, lang, count(*) as files, sum(octet_length(encode(text)))::bigint as bytes, count(*) filter (where text is null or text = '') as empty from documents group by rollup (source, lang)")
def byte_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes by folder, by its parts, and over all."""
    rows = table(spark, sf_dir, "documents").select("source", "lang", F.octet_length("text").cast("long").alias("size"), (F.coalesce("text", F.lit("")) == "").alias("empty"))
    return rows.rollup("source", "lang").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if("empty").alias("empty"))


@query(f"""with g as (select user_id, n, (n * 13) % 480 + 64 as h, (n * 7) % 640 + 64 as w from {LENGTHS}), f as (select arg_min(h, user_id) as h, arg_min(w, user_id) as w from g)
select g.user_id, f.h, f.w, g.h = f.h and g.w = f.w as same from g, f""")
def first_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first episode's shape, which all others are held against."""
    sized = episode_lengths(table(spark, sf_dir, "events")).select("user_id", (F.col("n") * 13 % 480 + 64).alias("own_h"), (F.col("n") * 7 % 640 + 64).alias("own_w"))
    first = sized.agg(F.min_by("own_h", "user_id").alias("h"), F.min_by("own_w", "user_id").alias("w"))  # one row
    return sized.crossJoin(F.broadcast(first)).select("user_id", "h", "w", ((F.col("own_h") == F.col("h")) & (F.col("own_w") == F.col("w"))).alias("same"))


@query("""with m as (select vec_id, list_transform(embedding, lambda x: x > 0) as mask from embeddings)
select vec_id, list_bool_and(mask) as all_set, list_bool_or(mask) as any_set, len(list_filter(mask, lambda x: not x)) as inverted from m""")
def mask_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform("embedding", lambda x: x > 0)
    inverted = F.transform(mask, lambda x: ~x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.forall(mask, lambda x: x).alias("all_set"), F.exists(mask, lambda x: x).alias("any_set"), F.size(F.filter(inverted, lambda x: x)).cast("long").alias("inverted"))


_BRIGHT = f"(0.8 + 0.4 * ({draw_sql(7, chr(39) + 'factor' + chr(39), 'vec_id')} / 4294967296.0::double))"


@query(f"""with a as (select vec_id, t, d, x, {draw_sql(7, "'bright'", "vec_id")} % 10 < 5 as bright, {draw_sql(7, "'mirror'", "vec_id")} % 10 < 3 as mirror, {_BRIGHT} as factor from {_CELLS})
select vec_id, t, case when mirror then 7 - d else d end as d, round(least(greatest(case when bright then abs(x) * 255 * factor else abs(x) * 255 end, 0), 255), 6) as x from a""")
def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images brightened with a chance of one half and mirrored with three tenths, by hashed draws."""
    key = F.col("vec_id")
    bright, mirror, factor = draw(7, "bright", key) % 10 < 5, draw(7, "mirror", key) % 10 < 3, 0.8 + 0.4 * (draw(7, "factor", key) / F.lit(4294967296.0))
    rows = _matrices(spark, sf_dir).select("vec_id", bright.alias("bright"), mirror.alias("mirror"), factor.alias("factor"), F.posexplode("actions").alias("t", "row"))
    cells = rows.select("vec_id", "bright", "factor", F.col("t").cast("long").alias("t"), F.posexplode(F.when(F.col("mirror"), F.reverse("row")).otherwise(F.col("row"))).alias("d", "x"))
    value = F.abs("x") * 255
    return cells.select("vec_id", "t", F.col("d").cast("long").alias("d"), rounded(clip(F.when(F.col("bright"), value * F.col("factor")).otherwise(value), F.lit(0.0), F.lit(255.0))).alias("x"))


@query("""with l as @LINES@,
p as (select doc_id, ls, @DRAW@ % greatest(len(ls), 1) as k from l) select doc_id, k as line, md5(coalesce(ls[k + 1], '')) as prompt from p where len(ls) > 0""".replace("@LINES@", _LINES).replace("@DRAW@", draw_sql(5, "'line'", "doc_id")))
def instruction_random_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn line of each document that has any."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.lines(F.col("text")).alias("ls")).where(F.size("ls") > 0)
    k = draw(5, "line", F.col("doc_id")) % F.size("ls")
    return rows.select("doc_id", k.alias("line"), F.md5(F.get("ls", k.cast("int")).cast("binary")).alias("prompt"))


@query("""with c as (select conv_id, turn, string_split(text, 'the') as parts from conversations)
select conv_id, turn, len(parts) - 1 as places, md5(list_reduce(list_transform(parts, lambda p, i: case when i > 1 then repeat('<pad>', ((conv_id + turn + i - 2) % 4)::bigint) else '' end || p), lambda a, b: a || b)) as filled from c""")
def placeholder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each placeholder becomes as many tokens as its own count."""
    places = F.size(F.split("text", "the")) - 1
    counts = F.transform(F.sequence(F.lit(0), F.greatest(places - 1, F.lit(0))), lambda i: ((F.col("conv_id") + F.col("turn") + i) % 4).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", places.cast("long").alias("places"), F.md5(tx.filled(F.col("text"), "the", counts, "<pad>").cast("binary")).alias("filled"))


@query("""with d as (select doc_id, translate(text, '_', ' ') as t from documents)
select doc_id, md5(trim(regexp_replace(lower(array_to_string(list_transform(string_split(t, '. '), lambda p: translate(p, '@DROP@', '')), '. ')), '@BLANKS@', ' ', 'g'))) as canonical from d where t is not null""".replace("@BLANKS@", tx.BLANKS).replace("@DROP@", "".join(c for c in tx.PUNCTUATION if c != "_").replace("'", "''")))
def canonical_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without punctuation but for one separator, the end of a sentence."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(tx.canonical(F.col("text"), ". ").cast("binary")).alias("canonical"))


@query(f"select doc_id, place from (select doc_id, row_number() over (order by {draw_sql(0, 'doc_id')}, doc_id) - 1 as place from documents) where place < 100")
def shuffled_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of a reproducible shuffle."""
    from pyspark.sql import Window

    first = table(spark, sf_dir, "documents").select("doc_id", draw(0, F.col("doc_id")).alias("at")).orderBy("at", "doc_id").limit(100)
    return first.select("doc_id", (F.row_number().over(Window.orderBy("at", "doc_id")) - 1).cast("long").alias("place"))  # a hundred rows


@query("""with r as (select 'orders' as root, o_orderkey as key, 1 as part from orders union all select 'parts', p_partkey, 0 from part union all select 'customers', c_custkey, 2 from customer)
select root, key, row_number() over (order by part, key) - 1 as global_idx from r""")
def multi_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several roots one after the other, each row with its number over all."""
    from trajlake.operators.ranking import positions

    roots = [("parts", "part", "p_partkey"), ("orders", "orders", "o_orderkey"), ("customers", "customer", "c_custkey")]
    parts = [table(spark, sf_dir, name).select(F.lit(root).alias("root"), F.col(key).alias("key"), F.lit(i).alias("part")) for i, (root, name, key) in enumerate(roots)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return positions(every, F.col("part").cast("long") * (1 << 40) + F.col("key"), name="global_idx").select("root", "key", "global_idx")


@query("select event_id, user_id, value from events where user_id in (select user_id from events group by user_id having count(*) % 3 = 0)")
def episode_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of some episodes only, by a semi join."""
    events = table(spark, sf_dir, "events")
    wanted = episode_lengths(events).where("n % 3 = 0").select("user_id")
    return events.join(wanted, "user_id", "left_semi").select("event_id", "user_id", "value")


@query("""select split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) as task, count(*) as files from pages where url like '%/en/%' group by 1""")
def tasks_with_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of a listing that own a required file."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").where("url like '%/en/%'").groupBy(F.split_part(path, F.lit("/"), F.lit(1)).alias("task")).agg(F.count("*").alias("files"))


@query("""with w as (select conv_id, turn, string_split(text, ' ') as ws from conversations), e as (select conv_id, turn, unnest(range(len(ws))) as pos, unnest(ws) as word from w),
m as (select conv_id, turn, word, min(pos) as pos from e where word <> '' and word not in ('the', 'a') group by all),
o as (select conv_id, word, min(turn * 1000000 + pos) as place from m group by 1, 2)
select conv_id, array_to_string(['the', 'a'] || list_slice(list(word order by place, word), 1, 20), ',') as keys, count(*) as n from o group by conv_id""")
def ordered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of two lists in the order of first sight, each once: fixed ones, then the first twenty other words of a chat."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    keys = batches.first_sight(words.where("word <> ''"), "conv_id", "word", ["turn", "pos"], ("the", "a"))
    return keys.select("conv_id", F.array_join(F.slice("keys", 1, 22), ",").alias("keys"), (F.size("keys") - 2).cast("long").alias("n")).where("n > 0")


@query("select conv_id, turn, md5(text) as repaired from conversations")
def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats of even number are broken, as UTF-8 read as Latin-1, and come out whole; the others stay."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    text = F.when(F.col("conv_id") % 2 == 0, broken).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.repaired(text).cast("binary")).alias("repaired"))
