"""Instructions, chats, tokens, paths and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions import chat
from trajlake.functions import text as tx
from trajlake.functions.keyed import draw, draw_sql
from trajlake.functions.vectors import pad
from trajlake.operators.batches import collate
from trajlake.plans.registry import query
from trajlake.sources import table


def _entities(x: str) -> str:
    for entity, char in tx.ENTITIES.items():
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


_LINES = f"(select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, '{tx.SPACES}')), lambda s: s <> '') as ls from documents)"
_DROP = "".join(c for c in tx.PUNCTUATION if c != "_").replace("'", "''")
_CANON = f"trim(regexp_replace(lower(translate(translate(trim({_entities(_entities('line'))}, '{tx.SPACES}'), '_', ' '), '{_DROP}', '')), '{tx.BLANKS}', ' ', 'g'))"


@query(f"""with l as {_LINES},
e as (select doc_id, unnest(range(len(ls))) as line_no, unnest(ls) as line from l)
select doc_id, line_no, md5({_CANON}) as canonical, length(line) as n_chars from e""")
def instruction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.may_be_broken(F.col("text")).alias("suspect"), tx.lines(F.col("text")).alias("ls"))
    # outer, for else the optimizer puts a filter below that splits and strips all texts twice more
    lines = docs.select("doc_id", "suspect", F.posexplode_outer("ls").alias("line_no", "line")).where("line is not null")
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5(tx.canonical(tx.clean(F.col("line"), F.col("suspect"))).cast("binary")).alias("canonical"), F.length("line").cast("long").alias("n_chars"))


@query(f"""select conv_id, turn, len(ls) as n, md5(array_to_string(list_transform(ls, lambda s: trim(replace(replace(s, 'que', chr(233) || '&' || chr(9829) || 'A' || chr(8364)), ' on ', '<' || chr(160) || '>'), '{tx.SPACES}')), '|')) as cleaned
from (select conv_id, turn, list_filter(list_transform(string_split(replace(text, '. ', chr(10)), chr(10)), lambda s: trim(s, '{tx.SPACES}')), lambda s: s <> '') as ls from conversations)""")
def entities_unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in which words stand as entities of every kind, named and numbered, some of them escaped twice, some without a semicolon."""
    text = F.replace(F.replace("text", F.lit("que"), F.lit("&eacute;&amp;amp;&amp;hearts;&#65;&#x80;")), F.lit(" on "), F.lit("&lt&nbsp;&amp;gt;"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean_lines(tx.lines(F.replace(text, F.lit(". "), F.lit("\n")))).alias("ls"))
    return rows.select("conv_id", "turn", F.size("ls").cast("long").alias("n"), F.md5(F.array_join("ls", "|").cast("binary")).alias("cleaned"))


@query(f"""with l as {_LINES},
p as (select doc_id, ls, {draw_sql(5, 'doc_id')} % 40 as k from l)
select doc_id, k as variant, md5('scene: ' || coalesce(ls[k + 1], ls[1], '')) as prompt from p""")
def instruction_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn line with a prefix; beyond the last line it is the first."""
    k = draw(5, F.col("doc_id")) % 40
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.lines(F.col("text")).alias("ls"), k.alias("variant"))
    line = F.coalesce(F.get("ls", F.col("variant").cast("int")), F.get("ls", F.lit(0)), F.lit(""))
    return rows.select("doc_id", "variant", F.md5(F.concat(F.lit("scene: "), line).cast("binary")).alias("prompt"))


_BROKEN_UP = "replace(replace(replace(text, ', ', chr(9) || chr(13) || chr(10) || chr(160)), '. ', chr(10) || chr(9) || chr(10) || '\u2003'), ' the ', chr(28) || chr(10) || chr(12))"


@query(f"""with l as (select conv_id, turn, list_filter(list_transform(string_split(trim({_BROKEN_UP}, '{tx.SPACES}'), chr(10)), lambda s: trim(s, '{tx.SPACES}')), lambda s: s <> '') as ls from conversations where trim(text, '{tx.SPACES}') <> '')
select conv_id, turn, len(ls) as n, md5(array_to_string(ls, '|')) as joined, {draw_sql(5, 'turn', 'conv_id')} % len(ls) as k, ls[1 + {draw_sql(5, 'turn', 'conv_id')} % len(ls)] as chosen from l""")
def instruction_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end and begin with white space of every kind, or have nothing else, and one of them drawn; a text without lines would fail."""
    text = F.expr(_BROKEN_UP)
    rows = table(spark, sf_dir, "conversations").where(tx.strip(F.col("text")) != "").select("conv_id", "turn", tx.lines_or_fail(text, F.concat_ws("/", "conv_id", "turn")).alias("ls"))
    k = draw(5, F.col("turn"), F.col("conv_id")) % F.size("ls")
    return rows.select("conv_id", "turn", F.size("ls").cast("long").alias("n"), F.md5(F.array_join("ls", "|").cast("binary")).alias("joined"), k.alias("k"), F.get("ls", k.cast("int")).alias("chosen"))


@query("""with m as (select *, row_number() over (partition by conv_id order by turn) as k from conversations)
select conv_id, count(*) as turns, count(*) filter (where role = 'user') as user_turns, count(*) filter (where role = 'assistant') as assistant_turns,
sum(length(text))::bigint as chars, max(case when k = 1 then role end) as opened_by from m group by conv_id""")
def chat_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = {f"{r}_turns": F.count_if(F.col("role") == r) for r in ("user", "assistant")}
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), *(c.alias(n) for n, c in roles.items()), F.sum(F.length("text")).alias("chars"), F.min_by("role", "turn").alias("opened_by"))


@query("""select conv_id, turn, md5(replace(text, 'the', repeat('<pad>', 3))) as filled, (length(text) - length(replace(text, 'the', ''))) // 3 as places from conversations""")
def placeholder_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each placeholder becomes three."""
    filled = F.replace(F.col("text"), F.lit("the"), F.lit("<pad>" * 3))
    places = F.floor((F.length("text") - F.length(F.replace(F.col("text"), F.lit("the"), F.lit("")))) / 3)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(filled.cast("binary")).alias("filled"), places.cast("long").alias("places"))


@query(r"""with w as (select conv_id, list_filter(string_split_regex(string_agg(text, ' ' order by turn, text), '[ \t\n\r\f\x0B]+'), lambda w: w <> '') as ws from conversations group by 1),
e as (select conv_id, unnest(range(len(ws))) as pos, unnest(list_transform(ws, lambda w: case when length(w) <= 3 then 1 else length(w) end)) as id, len(ws) as n from w),
b as (select *, coalesce(lag(id) over (partition by conv_id order by pos), last_value(id) over (partition by conv_id order by pos rows between unbounded preceding and unbounded following)) as before from e)
select conv_id, count(*) filter (where id = 4 and before = 1) as images, count(*) filter (where id = 5 and before = 1) as videos from b group by conv_id""")
def media_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image and video marks right after a start mark in the token ids of a chat; before the first comes the last."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(texts, " ").alias("text"))
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    ids = chats.select("conv_id", F.transform(words, lambda w: F.when(F.length(w) <= 3, 1).otherwise(F.length(w))).alias("ids"))
    return ids.where(F.size("ids") > 0).select("conv_id", *chat.media_counts(F.col("ids"), 1, 4, 5))


@query("select event_id, coalesce(cast(json_extract(props, '$.k') as bigint), -1) as k from events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"))


_TOKENS = "list_transform(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> ''), lambda w: length(w)::bigint)"


def _tokens() -> Column:
    """Word lengths stand for token ids."""
    return F.transform(F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != ""), lambda w: F.length(w).cast("long"))


@query(f"""with t as (select conv_id, turn, {_TOKENS} as ids from conversations), m as (select *, max(len(ids)) over (partition by conv_id) as longest from t),
e as (select conv_id, turn, ids, longest, unnest(range(longest)) as pos from m)
select conv_id, turn, pos, coalesce(ids[pos + 1], 0) as id, case when pos < len(ids) then 1 else 0 end as mask from e""")
def collate_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", _tokens().alias("tokens"))
    batch = collate(rows, "conv_id", "tokens", "turn")
    zipped = F.posexplode(F.arrays_zip("ids", "mask")).alias("pos", "z")
    return batch.select("conv_id", "turn", zipped).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("z.ids").alias("id"), F.col("z.mask").alias("mask"))


@query(f"""with t as (select doc_id, {_TOKENS} as ids from documents)
select doc_id, least(len(ids), 512) as kept, greatest(512 - len(ids), 0) as padded, list_sum(ids[1:512])::bigint as total from t where len(ids) > 0""")
def pad_truncate_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", _tokens().alias("ids")).where(F.size("ids") > 0)
    fixed = rows.withColumn("fixed", pad(F.col("ids"), 512, F.lit(0).cast("long")))
    zeros = F.size(F.filter("fixed", lambda x: x == 0)).cast("long")
    return fixed.select("doc_id", (512 - zeros).alias("kept"), zeros.alias("padded"), F.aggregate("fixed", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""with p as (select page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') as parts from pages)
select page_id, parts[1] as host, regexp_replace(parts[len(parts)], '[.?#].*$', '') as stem, regexp_matches(regexp_replace(parts[len(parts)], '[.?#].*$', ''), '^[0-9]+$') as numeric,
case when list_contains(parts, 'en') then 'en' when list_contains(parts, 'de') then 'de' end as split, 'page_' || case when length(page_id::varchar) < 6 then lpad(page_id::varchar, 6, '0') else page_id::varchar end as name, 'chunk-' || case when page_id < 100000 then lpad((page_id // 1000)::varchar, 3, '0') else (page_id // 1000)::varchar end as chunk from p""")
def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/").alias("parts"))
    stem = F.regexp_replace(F.element_at("parts", -1), r"[.?#].*$", "")
    part = F.when(F.array_contains("parts", "en"), "en").when(F.array_contains("parts", "de"), "de")
    return pages.select("page_id", F.get("parts", F.lit(0)).alias("host"), stem.alias("stem"), stem.rlike("^[0-9]+$").alias("numeric"), part.alias("split"), tx.padded("page_", F.col("page_id"), 6).alias("name"), tx.padded("chunk-", F.floor(F.col("page_id") / 1000), 3).alias("chunk"))


@query("""with p as (select event_id, '  ' || upper(event_type) || '-Mode ' as raw, (user_id % 14)::varchar || ', ,' || (event_id % 14)::varchar as list, case when event_id % 2 = 0 then 'Yes' else 'f' end as flag from events)
select event_id, translate(lower(trim(raw)), '-', '_') as mode, translate(lower(trim(raw)), '-', '_') in ('click_mode', 'view_mode') as known,
(trim(string_split(list, ',')[1]))::int as first, (trim(string_split(list, ',')[3]))::int as second, lower(flag) in ('yes', 'true', 't', 'y', '1') as flag from p""")
def mode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    raw = F.concat(F.lit("  "), F.upper("event_type"), F.lit("-Mode "))
    listed = F.concat((F.col("user_id") % 14).cast("string"), F.lit(", ,"), (F.col("event_id") % 14).cast("string"))
    mode, numbers = tx.mode_name(raw), tx.integers(listed)
    return events.select("event_id", mode.alias("mode"), mode.isin("click_mode", "view_mode").alias("known"), F.get(numbers, F.lit(0)).alias("first"), F.get(numbers, F.lit(1)).alias("second"), tx.boolean(F.when(F.col("event_id") % 2 == 0, "Yes").otherwise("f")).alias("flag"))
