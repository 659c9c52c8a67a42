"""The operators applied to the given tables: one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, fingerprints, hard_negatives, line_dedup, lm_scoring, mixing, packing, periodic_runs, quality_classifier, quality_rules, simhash_dedup, suffix_dedup, url_filters
from llm.common import read


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deleted_lines(read(spark, sf_dir, "documents"))


#: Host, path, verdict, by the contract.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"select * from values {_RULES_SQL} as rules(host, path, verdict)")
    return url_filters.judge(read(spark, sf_dir, "pages"), rules)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(read(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score_documents(read(spark, sf_dir, "documents"))
    sums = {c: F.round(c, 6) for c in ("base_score", "score")}
    return scored.withColumns({**sums, "mean_score": F.round(F.col("score") / F.col("n_tokens"), 6)})


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents")).withColumn("target", F.round("target", 3))


def with_periods(documents: DataFrame) -> DataFrame:
    """A tenth of the documents, chosen by a hash of doc_id, with words that repeat from a chosen one on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    chosen = (h % 10 == 0) & (F.btrim("text", F.lit(" \t\n\x0b\f\r")) != "")
    rows = documents.select("doc_id", "text", F.when(chosen, words).alias("words"), F.floor(h / 10).cast("long").alias("g"))
    n = F.size("words")
    rows = rows.withColumns({"n": n, "a": F.when(n > 0, F.col("g") % n).cast("int")})
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    turns = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    edited = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(turns, F.lit(1), left))
    return rows.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_periods(read(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", periodic_runs.strongest("runs"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli, F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def labelled_vectors(embeddings: DataFrame) -> DataFrame:
    """Vectors of whole numbers; a seventh of the labels is moved on by one; ids divisible by 50 are anchors."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    id_ = F.col("vec_id").cast("long")
    label = F.when(id_ % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    return embeddings.where(F.col("label").isNotNull() & finite).select(id_.alias("id"), label.alias("label"), vector.alias("vector"), (id_ % 50 == 0).alias("anchor"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(labelled_vectors(read(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
#: The SQL stands as given: its net/de/ blocks, where the contract and the query allow.
_OP4_SQL = """
with rules(host, path, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
cut as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
parsed as (select row_number() over () as n, page_id,
  coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
fits as (select p.n, r.host || r.path as rule, r.verdict, length(r.host) + length(r.path) as size
  from parsed p join rules r on (p.host = r.host or p.host like '%.' || r.host) and starts_with(p.path, r.path)),
best as (select n, arg_max(rule, size) as rule, arg_max(verdict, size) as verdict from fits group by n)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parsed left join best using (n)
"""


#: Every string of 400 bytes, and every run of 51 words, by its md5; what is covered by those found more than once goes.
_OP1_SQL = r"""
with docs as (select row_number() over () as n, doc_id, encode(coalesce(text, '')) as b, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
starts as (select n, unnest(range(octet_length(b) - 399)) as i, b from docs where octet_length(b) >= 400),
named as (select n, i, md5(b[i + 1:i + 400]) as name from starts),
hits as (select n, i from (select n, i, count(*) over (partition by name) as c from named) where c > 1),
marked as (select n, i, case when i - lag(i) over (partition by n order by i) <= 400 then 0 else 1 end as new from hits),
islands as (select n, i, sum(new) over (partition by n order by i) as island from marked),
spans as (select n, island, min(i) as s, max(i) + 400 as e from islands group by n, island),
cuts as (select n, s, e, coalesce(lag(e) over (partition by n order by s), 0) as before, lead(s) over (partition by n order by s) is null as final from spans),
kept as (select d.n, string_agg(hex(d.b[c.before + 1:c.s]) || case when c.final then hex(d.b[c.e + 1:octet_length(d.b)]) else '' end, '' order by c.s) as h, sum(c.e - c.s)::bigint as removed, count(*) as spans from cuts c join docs d on d.n = c.n group by d.n),
word_named as (select n, i, md5(array_to_string(words[i + 1:i + 51], ' ')) as name from (select n, words, unnest(range(len(words) - 50)) as i from docs where len(words) >= 51)),
word_hits as (select n, i from (select n, i, count(*) over (partition by name) as c from word_named) where c > 1),
word_marked as (select n, i, case when i - lag(i) over (partition by n order by i) <= 51 then 0 else 1 end as new from word_hits),
word_spans as (select n, max(i) + 51 - min(i) as size from (select n, i, sum(new) over (partition by n order by i) as island from word_marked) group by n, island),
passages as (select n, sum(size)::bigint as words, count(*) as passages from word_spans group by n)
select doc_id, octet_length(b) as n_bytes, coalesce(k.removed, 0) as n_removed, coalesce(k.spans, 0) as n_spans, case when k.n is null then sha256(b) else sha256(unhex(k.h)) end as kept_sha256,
coalesce(p.words, 0) as n_passage_words, coalesce(p.passages, 0) as n_passages from docs d left join kept k on k.n = d.n left join passages p on p.n = d.n
"""
#: CRC-32 of doc_id as text, bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint)),
  lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)))"""
#: The model by its formula, with discount 1/2: arcs of bigrams, or the failure arc of the history and the root's arc.
_OP10_SQL = r"""
with docs as (select row_number() over () as n, doc_id, crc % 7 = 2 as held_out, words from (select doc_id, @CRC@ as crc,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents)),
placed as (select n, held_out, unnest(list_append(list_transform(words, lambda w: 'w' || w), 'end')) as token, unnest(range(len(words) + 1)) as place from docs),
tokens as (select *, coalesce(lag(token) over (partition by n order by place), 'end') as history from placed),
c as (select token, count(*) as c from tokens where not held_out group by token),
corpus as (select coalesce(sum(c), 0) as tokens, count(*) as words from c),
pairs as (select history, token, count(*) as both_ from tokens where not held_out group by history, token),
takes as (select history, sum(both_ - 0.5::double) as takes from pairs group by history),
chances as (select t.n, coalesce(c.c, 0) as c, corpus.tokens, corpus.words, h.c as ch, p.both_,
  case when h.c > 0 then greatest(1 - coalesce(k.takes, 0) / h.c, 1e-12) else 1.0::double end as left_,
  (greatest(coalesce(c.c, 0) - 0.5::double, 0) + 0.5::double * corpus.words / (corpus.words + 1)) / corpus.tokens as share
  from tokens t cross join corpus left join c on c.token = t.token left join c h on h.token = t.history
  left join pairs p on p.history = t.history and p.token = t.token left join takes k on k.history = t.history),
sums as (select n, count(*) as n_tokens, count(*) filter (c > 0) as n_known, any_value(tokens)::bigint as train_tokens,
  sum(log10((c + 1) / (tokens + words + 1)::double)) as base_score,
  sum(log10(case when both_ > 0 then (both_ - 0.5::double) / ch else 0 end + left_ * share)) as score from chances group by n)
select doc_id, held_out, n_tokens, n_known, train_tokens, round(base_score, 6) as base_score, round(score, 6) as score,
  round(score / n_tokens, 6) as mean_score from docs join sums using (n)
""".replace("@CRC@", _CRC_SQL)
#: The level of the water by trying every set of clamped sources, and the order of a source as one window.
_OP11_SQL = r"""
with docs as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  ('0x' || substr(md5('11:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint as draw from documents),
sizes as (select source, sum(size)::bigint as source_size from docs group by source),
weighted as (select *, list_extract([3.0::double, 1.0, 2.0], 1 + (row_number() over (order by source nulls last) - 1)::int % 3) as weight from sizes),
tried as (select (1.5 * (select sum(source_size) from weighted) - coalesce(sum(2 * b.source_size) filter (2 * b.source_size / b.weight < 2 * a.source_size / a.weight), 0))::double
  / sum(b.weight) filter (2 * b.source_size / b.weight >= 2 * a.source_size / a.weight) as level from weighted a cross join weighted b group by a.source, a.source_size, a.weight),
aims as (select source, source_size, least(2.0 * source_size, (select max(level) from tried) * weight)::double as target from weighted),
budgets as (select *, floor(target + 0.5)::bigint as budget from aims),
placed as (select *, (sum(size) over (partition by source order by draw, doc_id nulls first, size rows unbounded preceding) - size)::bigint as start from docs)
select doc_id, size, source_size, round(target, 3) as target, case when source_size > 0 then (budget // source_size) * size
  + greatest(0, least(size, budget % source_size - start)) else 0 end::bigint as taken
from placed p join budgets b on p.source is not distinct from b.source
"""
#: Equal words of a text at a distance of a quarter of its length at most; those that follow one another at one distance are a stretch.
_OP12_SQL = r"""
with docs as (select row_number() over () as n, doc_id, @CRC@ as h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as given from documents),
chosen as (select *, len(given) as size, case when h % 10 = 0 and len(given) > 0 then (h // 10) % len(given) end as a from docs),
periods as (select *, case when a is not null then 1 + (size - a) // (3 + (h // 10) % 8) end as p from chosen),
tokens as (select n, size, i, given[1 + case when i >= a then a + (i - a) % p else i end] as w from (select *, unnest(range(size)) as i from periods)),
pairs as (select a.n, a.i, b.i - a.i as q from tokens a join tokens b on a.n = b.n and a.w = b.w and b.i > a.i and 4 * (b.i - a.i) <= a.size),
islands as (select n, q, i, i - row_number() over (partition by n, q order by i) as island from pairs),
long as (select n, q, min(i) as s, count(*) + q as size from islands group by n, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as (select * from long x where not exists (select 1 from long y where y.n = x.n and y.q < x.q and x.q % y.q = 0 and y.s <= x.s and y.s + y.size >= x.s + x.size)),
sums as (select n, count(*) as n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' order by s, q) as listed from runs group by n),
best as (select n, s, size, q from (select *, row_number() over (partition by n order by (size * (select max(q) from runs) * 1000000::hugeint) // q desc, s, q) as place from runs) where place = 1),
gone as (select distinct n, i from (select n, unnest(range(s + q, s + size)) as i from runs)),
kept as (select n, string_agg(w, ' ' order by i) as words from tokens t anti join gone g using (n, i) group by n)
select doc_id, coalesce(n_runs, 0) as n_runs, b.s as start, b.size as length, b.q as period, 1000 * b.size // b.q as exponent_milli,
  sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256 from docs d left join sums using (n) left join best b using (n) left join kept using (n)
""".replace("@CRC@", _CRC_SQL)
#: Every anchor with every row.
_OP13_SQL = """
with whole as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as vector
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select a.id as anchor_id, b.id, a.label = b.label as same, list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: z[1] * z[2]))::bigint as score
  from whole a join whole b on a.id % 50 = 0 and a.id <> b.id),
positives as (select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as place from scores where same) where place <= 5),
negatives as (select p.anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score,
  row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) as rank
  from positives p join scores n on n.anchor_id = p.anchor_id and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negatives where rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array_dedup": _OP1_SQL, "op4_url_filters": _OP4_SQL, "op10_lm_scoring": _OP10_SQL, "op11_mixing": _OP11_SQL, "op12_periodic_runs": _OP12_SQL, "op13_hard_negatives": _OP13_SQL}
